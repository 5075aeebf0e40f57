"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Permitted sequence lengths in tokens, and the fixed cost in tokens of a sequence of any length.
CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Tokens that one task packs, about.
TOKENS_PER_TASK = 4_000_000


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens, and one that ends the document."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return (words + 1).cast("long")


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) for each of `lengths`, none above the largest capacity.

    Pieces are taken by falling length. Each goes to the open bin with the least room that holds it. If
    none does, a bin opens whose capacity costs least for each token it can be expected to hold, which the
    lengths still to come decide: a capacity counts its size and overhead against the piece and what of
    the shorter pieces left can fill the rest. Last, each bin shrinks to the least capacity that holds its contents.
    """
    caps = np.array(sorted(capacities))
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    rising = -falling
    ahead = np.concatenate((np.cumsum(falling[::-1])[::-1], [0]))  # tokens from each piece on
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room_of: list[int] = []
    used: list[int] = []
    open_by_room: list[tuple[int, int]] = []
    for at, i in enumerate(order.tolist()):
        size = int(lengths[i])
        k = bisect_left(open_by_room, (size, -1))
        if k < len(open_by_room):
            room, b = open_by_room.pop(k)
        else:
            b, best = len(used), None
            left = int(ahead[at + 1])
            for cap in caps[caps >= size].tolist():
                rest = cap - size
                # pieces longer than the rest can't fill it; those that can come later
                later = int(np.searchsorted(rising[at + 1 :], -rest)) + at + 1 if rest and left else n
                filled = size + min(rest, int(ahead[min(later, n)]))
                cost = (cap + overhead) / filled
                if best is None or cost < best[0]:
                    best = (cost, cap)
            room = best[1]
            used.append(0)
            room_of.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room - size > 0:
            insort(open_by_room, (room - size, b))
    final = caps[np.searchsorted(caps, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if n else np.zeros(0, np.int64)


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, pack, bin, offset, capacity): where each piece of each row lies.

    A document of more tokens than the largest capacity is cut into pieces of that length and a rest, so no
    token is dropped. Pieces are dealt by hash to packs of about TOKENS_PER_TASK tokens, each packed by
    itself; (pack, bin) names a sequence. Rows that share an id or have none are dealt apart. Null and empty texts have the one token that ends them. Repeated
    rows are packed each; a null doc_id like any other; an empty table gives no rows; other columns are ignored.
    """
    most = max(capacities)
    # Two numbers a row are kept, so that texts are read once; the row's own number deals out rows that share an id.
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), (token_count(F.col(text_col)) if tokens is None else tokens).alias("tokens"), F.monotonically_increasing_id().alias("row")))
    pieces = sized.select("doc_id", "row", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("tokens", F.lit(1)) - 1) / most))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start_token"), F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece") * most).alias("n_tokens"))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    packs = max(1, -(-total // TOKENS_PER_TASK))

    def one(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, capacity = pack(got["n_tokens"].to_numpy(np.int64), capacities, overhead)
        return got.assign(bin=bins, offset=offsets, capacity=capacity)

    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(packs))).drop("row")
    return dealt.groupBy("pack").applyInPandas(one, "doc_id long, piece long, start_token long, n_tokens long, pack long, bin long, offset long, capacity long")
