"""Benchmark decontamination by spaced-seed hashing, in SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Which token positions of a window count. Any 13 tokens with 2 substitutions keep some window of one of these whole.
MASKS = ("1111001001", "1011111", "1101010011")
#: A leak aligns so many equal tokens at least, and such a share of the aligned ones.
LEAST_EQUAL, LEAST_SHARE = 11, 0.8
#: Tokens of a text that are searched as one row; longer texts go in blocks that overlap by an item's length.
BLOCK = 4096
#: Seeds of the benchmark that are broadcast at once, 40 bytes each; a larger benchmark is searched in blocks.
SEEDS_AT_ONCE = 200_000


def token_hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the lower-cased runs of letters and digits in `text`."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(keep…, at, seed): one row for each mask at each token position; masks are kept apart by their number."""
    placed = df.select(*keep, tokens, F.posexplode(tokens).alias("at", "token"))
    keys = [F.xxhash64(F.lit(k), *[F.get(tokens, F.col("at") + i) for i, c in enumerate(mask) if c == "1"]) for k, mask in enumerate(MASKS)]
    return placed.select(*keep, "at", F.explode(F.array(*keys)).alias("seed"))


def _ranked(places: Column, least_share: float) -> Column:
    """Array of struct(key, ends, k), sorted: the k-th agreement as a run's first (ends 0) and as its last (ends 1).

    The run from agreement a to b has b - a + 1 equal tokens of places[b] - places[a] + 1. It holds the share if a stands
    before b here.
    """
    share = F.lit(round(least_share * 1000))
    above = lambda p, k: F.lit(1000) * k - share * p
    first = F.transform(places, lambda p, k: F.struct(above(p, k).alias("key"), F.lit(0).alias("ends"), k.alias("k")))
    last = F.transform(places, lambda p, k: F.struct((above(p, k) + 1000 - share).alias("key"), F.lit(1).alias("ends"), k.alias("k")))
    return F.sort_array(F.concat(first, last))


def _most_equal(ranked: Column) -> Column:
    """The most equal tokens of any run that holds the share: each last agreement with the earliest first before it in `ranked`."""
    def step(s: Column, e: Column) -> Column:
        least = F.when(e["ends"] == 0, F.least(s["least"], e["k"])).otherwise(s["least"])
        most = F.when(e["ends"] == 1, F.greatest(s["most"], e["k"] - s["least"] + 1)).otherwise(s["most"])
        return F.struct(least.alias("least"), most.alias("most"))

    zero = F.struct(F.lit(2**30).alias("least"), F.lit(0).alias("most"))
    return F.aggregate(ranked, zero, step, lambda s: s["most"])


def _shortest_run(places: Column, equal: Column) -> Column:
    """struct(size, first) of the shortest run with `equal` agreements, the first of equals. It holds the share if any such run does."""
    runs = F.transform(F.sequence(F.lit(0), F.size(places) - equal), lambda k: F.struct((F.get(places, k + equal - 1) - F.get(places, k) + 1).alias("size"), F.get(places, k).alias("first")))
    return F.array_min(runs)


def _blocks(texts: DataFrame, margin: int) -> DataFrame:
    """(doc_id, base, core, end, tokens): each text in blocks, with `margin` tokens more on both sides.

    base is the place of a block's first token in the text; core to end is the block without its margins.

    A row's hits are held until the row is done, so that a very long or repetitive text must not be one row.
    """
    size = max(BLOCK, 8 * margin)
    before = lambda s: F.least(s, F.lit(margin))
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(size))
    part = lambda s: F.struct((s - before(s)).alias("base"), before(s).alias("core"), F.slice(F.col("tokens"), s - before(s) + 1, F.lit(size + margin) + before(s)).alias("tokens"))
    found = texts.select("doc_id", F.explode(F.transform(starts, part)).alias("b"))
    return found.select("doc_id", "b.base", "b.core", (F.col("b.core") + size).alias("end"), "b.tokens")


def _search(texts: DataFrame, items: DataFrame, margin: int, least_equal: int, least_share: float) -> DataFrame:
    """All aligned runs of `items` (item_id, bench) in `texts` (doc_id, tokens). `items` is small enough to broadcast."""
    seeds = _seeds(items, "bench", "item_id").select("item_id", F.col("at").alias("item_at"), "seed").distinct()
    found = _seeds(_blocks(texts, margin), "tokens", "doc_id", "base", "core", "end", "tokens").join(F.broadcast(seeds), "seed").where("at >= core AND at < end")
    named = items.select(F.col("item_id").alias("named_id"), "bench")
    found = found.join(F.broadcast(named), F.col("item_id").eqNullSafe(F.col("named_id")))
    # Of a block only what lies along the item goes on.
    shift = F.col("at") - F.col("item_at")
    along = F.slice("tokens", F.greatest(shift, F.lit(0)) + 1, F.greatest(F.size("bench") + F.least(shift, F.lit(0)), F.lit(0)))
    found = found.select("doc_id", "item_id", shift.alias("local"), (F.col("base") + shift).alias("shift"), along.alias("along"), "bench")
    skip = F.greatest(-F.col("local"), F.lit(0))
    agree = F.transform("bench", lambda b, j: F.coalesce(F.get(F.col("along"), F.when(j >= skip, j - skip)) == b, F.lit(False)))
    # `along` is named twice, so that the planner keeps it as a column and doesn't copy it into the lambda.
    agree = F.when(F.size("along") >= least_equal, agree)
    found = found.select("doc_id", "item_id", "shift", agree.alias("agree")).where(F.size(F.filter("agree", lambda x: x)) >= least_equal)
    once = found.groupBy("doc_id", "item_id", "shift").agg(F.first("agree").alias("agree"))
    places = F.filter(F.transform("agree", lambda x, j: F.when(x, j)), lambda j: j.isNotNull())
    run = let(places, lambda p: let(_most_equal(_ranked(p, least_share)), lambda n: F.when(n >= least_equal, F.struct(n.alias("equal"), _shortest_run(p, n).alias("at")))))
    run = once.select("doc_id", "item_id", "shift", run.alias("run")).where("run IS NOT NULL")
    return run.select(
        "doc_id", "item_id", F.col("run.equal").cast("long").alias("equal_tokens"), F.col("run.at.size").cast("long").alias("aligned_tokens"),
        (F.col("shift") + F.col("run.at.first")).cast("long").alias("doc_token"), F.col("run.at.first").cast("long").alias("item_token"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, least_equal: int = LEAST_EQUAL, least_share: float = LEAST_SHARE, seeds_at_once: int = SEEDS_AT_ONCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, equal_tokens, aligned_tokens, doc_token, item_token): the longest overlap of each pair that leaks.

    Seeds of texts and items meet in an equi-join; around each hit the whole item is laid along the text, and
    of all runs with at least `least_share` equal tokens the one with the most must hold `least_equal`; of equals the shortest.
    Ties go to the earliest place in the text. Items are deduplicated by item_id and tokens; items of fewer
    than `least_equal` tokens, null or empty texts match nothing. Repeated rows give one row; a null doc_id or
    item_id is an id like others. An empty table gives no rows; other columns are ignored. A benchmark of
    more than `seeds_at_once` seeds is searched in blocks, each over all of `docs`.
    """
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("bench")).where(F.size("bench") >= least_equal).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), token_hashes(F.col(text_col)).alias("tokens"))
    sizes = items.agg(F.sum(F.size("bench")).alias("n"), F.max(F.size("bench")).alias("most")).first()
    held, margin = sizes["n"] or 0, (sizes["most"] or 0) + max(map(len, MASKS))
    blocks = max(1, -(-held * len(MASKS) // seeds_at_once))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "bench"), F.lit(blocks)) == k)
        some = _search(texts, part, margin, least_equal, least_share)
        found = some if found is None else found.unionByName(some)
    best = F.max_by(F.struct("equal_tokens", "aligned_tokens", "doc_token", "item_token"), F.struct("equal_tokens", -F.col("aligned_tokens"), -F.col("doc_token"), -F.col("item_token")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id leaks no item. Rows with a null doc_id stay unless such a row leaks."""
    found = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaking"]), "left_anti")
