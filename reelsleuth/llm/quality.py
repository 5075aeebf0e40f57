"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, of order 2 over words.

The chance of a word after another is a + g * l: a discounted count of the pair, the context's weight of the lower order, and the
word's own chance by the number of words that it follows. In logarithms a text's loss is then a sum over its words and
pairs, in which words and pairs that trusted text lacks add nothing but a constant:

    log p(w | v) = log u + [log l(w) - log u] + [log g(v)] + [log(1 + a(v, w) / (g(v) l(w)))]

with u the chance of an unseen word. So documents meet the model in joins of their counted words and pairs with the
counts of trusted text, shard by shard of the context, and each document's shares are added up. Counts are of whole words, as many
as the text has; tables and joins grow with it, and shards are as many as their size asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fetch, fresh_dir, put, release, trim

#: Documents are scored by the model of the other fold's trusted text, so that no text vouches for itself.
FOLDS = 2
#: Of a language's trusted documents, the shares that lie below its lower and above its upper threshold.
BELOW, ABOVE = 0.0005, 0.005
#: Tokens of average trusted text that are added to each text, so that a few odd words don't decide.
PRIOR_TOKENS = 10
#: Ids or texts that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of trusted text of one shard, about; shards are a power of two.
SHARD_BYTES = 6_000_000
#: Symbols that are counted at once, and of a longer document's pieces; and bytes of the texts that are read at once, a longer one apart:
#: symbols of several such slices make a block, for a text's bytes take some ten times their size while its words are found.
BLOCK, SLICE_BYTES = 1 << 20, 2_000_000
#: Bits of a fold's filter at most (16 MB): each word and pair of trusted text sets one. Words and pairs of texts whose bit isn't set
#: don't travel; a full filter lets all of them through, so that its size bears on traffic alone.
FILTER_BITS = 27
#: Most frequent words of a fold, about, whose values every task holds (1 MB): they are in nearly all texts and don't travel.
HEAD_WORDS = 1 << 16
#: What stands for a word in the filter, as if it came after it.
ALONE = np.uint64(0xFFFFFFFF)

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power of each place in a megabyte, and its inverses, modulo 2^64."""
    def table(base: int) -> np.ndarray:
        out = np.full(1 << 20, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def symbols(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (32 bits each) of texts, one after the other, and how many each has. lower: A-Z count as a-z.

    A text with words has symbol 0, then its words' hashes; without words it has none. Words are runs between blanks
    (x20, x09 to x0D). Each word's hash is a polynomial of its bytes, from running sums over all bytes.
    """
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    _, offsets, buffer = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(buffer, np.uint8)[offs[0] : offs[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if lower:  # not by Arrow's ascii_lower: of a slice that was cast it keeps the old offsets, and texts are lost (23.0)
        data = _LOWER[data]
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + len(up), "right")))
        part = data[starts[at] : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
        if len(part) > len(up):  # one word of over a megabyte
            hashes[at] = np.bitwise_xor.reduce(_mixed(part + np.arange(len(part), dtype=np.uint64)))
        else:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
            s, e = starts[at:stop] - starts[at], ends[at:stop] - starts[at]
            hashes[at:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = stop
    ids = np.maximum(_mixed(hashes) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    many = np.searchsorted(starts, offs[1:]) - np.searchsorted(starts, offs[:-1])
    sizes = many + (many > 0)
    out = np.zeros(int(sizes.sum()), np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.cumsum(many > 0), many)] = ids
    return out, sizes


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some `size` bytes of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def blocks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(symbols, how many each text has, values of `columns`) of whole texts: as many slices as stay within BLOCK symbols, one at least."""
    got, n = [], 0
    for batch in (x for b in batches for x in slices(b)):
        syms, sizes = symbols(batch.column("text"))
        if got and n + len(syms) > BLOCK:
            yield tuple(map(np.concatenate, zip(*got)))
            got, n = [], 0
        got.append((syms, sizes, *(batch.column(c).to_numpy() for c in columns)))
        n += len(syms)
    if got:
        yield tuple(map(np.concatenate, zip(*got)))
    trim()


def _pairs(syms: np.ndarray) -> np.ndarray:
    """Each symbol with the one after it; the last of a text with 0, which begins the next."""
    return syms.astype(np.uint64) << np.uint64(32) | np.append(syms[1:], np.uint32(0))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted `keys`, and how often each occurs."""
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed bytes, the first bytes of all numbers first; of a rising one the steps."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, kind, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def bundle(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unbundle(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<u4"), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def pack_lists(keys: np.ndarray, who: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, each with the documents that hold it in order and how often: keys once, steps between documents."""
    new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    at = np.flatnonzero(new)
    steps = who.copy()
    steps[1:] = np.where(new[1:], who[1:], who[1:] - who[:-1])
    return bundle(pack(keys[at], True), pack(np.diff(np.append(at, len(keys))).astype(np.uint32)), pack(steps), pack(n.astype(np.uint32)))


def unpack_lists(raw: bytes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, how many documents each has, documents, counts) of pack_lists()."""
    keys, many, steps, n = unbundle(raw)
    keys, many, steps, n = unpack(keys, kind, True), unpack(many, np.uint32).astype(np.int64), unpack(steps, np.uint16).astype(np.int64), unpack(n, np.uint32)
    at, sums = np.cumsum(many) - many, np.cumsum(steps)
    return keys, many, sums - np.repeat(sums[at] - steps[at], many), n


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1 to 4."""
    if not n1 or not n2 or not n3 or not n4:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


def _few(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def fold_of(text: Column) -> Column:
    """Equal texts share a fold."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def _shards(keys: np.ndarray, bits: int, low: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted `keys` by the top `bits` of what lies above their `low` lowest bits, all in 32 + low bits."""
    shard = (keys >> np.uint64(32 + low - bits)).astype(np.int64)
    names, at = np.unique(shard, return_index=True) if len(shard) else ([], [])
    for k, s, e in zip(names, at, [*at[1:], len(keys)] if len(shard) else []):
        yield int(k), slice(int(s), int(e))


def _place(keys: np.ndarray, shard_bits: int, bits: int) -> np.ndarray:
    """The filter's bit of each pair: those of a shard lie together."""
    own = bits - shard_bits
    shard = keys >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(keys), np.uint64)
    return shard << np.uint64(own) | _mixed(keys) >> np.uint64(64 - own)


@lru_cache(maxsize=1)
def _filter(folder: str, fold: int, shard_bits: int, bits: int) -> np.ndarray:
    """A fold's bit for each place, once a worker."""
    size = max(1, (1 << bits >> shard_bits) // 8)
    out = np.zeros(size << shard_bits, np.uint8)
    for name in fetch(f"{folder}/names").decode().split():
        f, shard = map(int, name.split("-"))
        if f == fold:
            out[shard * size : (shard + 1) * size] = np.frombuffer(fetch(f"{folder}/{name}"), np.uint8)
    return out


@lru_cache(maxsize=1)
def _head(folder: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, values) of the most frequent words of each fold, once a worker."""
    out = []
    for raw in unbundle(fetch(f"{folder}/head")):
        words, values = unbundle(raw)
        out.append((unpack(words, np.uint32, True), unpack(values, np.float64)))
    return out


def _found(table: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for, 0 for those that aren't in the sorted table."""
    at = np.minimum(np.searchsorted(table, asked), max(0, len(table) - 1))
    return np.where(table[at] == asked, values[at], 0.0) if len(table) else np.zeros(len(asked))


def _shard_counts(folder: str, fold: int, shard: int) -> tuple[np.ndarray, ...]:
    """(pairs, counts, contexts, where each context's pairs begin, how many it has) of a shard's table."""
    rising, n = unbundle(fetch(f"{folder}/{fold}-{shard}.counts"))
    keys, n = unpack(rising, np.uint64, True), unpack(n, np.uint32).astype(np.int64)
    heads = (keys >> np.uint64(32)).astype(np.uint32)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(heads)), bool), heads[1:] != heads[:-1])))
    return keys, n, heads[at], at, np.diff(np.append(at, len(keys)))


def _word_values(words: np.ndarray, n: np.ndarray, heads: np.ndarray, weight: np.ndarray, stats: tuple) -> np.ndarray:
    """What each word of a shard adds to a text's log chance: its own against an unseen word's, and its weight of the lower order."""
    d1, types, unseen, _ = stats
    return np.log(((n - d1[np.minimum(n, 3)]) / types + unseen) / unseen) + _found(heads, np.log(weight), words)


_ROW = "kind string, fold int, shard int, block long, a binary, b binary, c binary, few array<long>"
_COLUMNS = [x.split()[0] for x in _ROW.split(", ")]
_SCHEMA = pa.schema([("kind", pa.string()), ("fold", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("few", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], t.type) for t in _SCHEMA], schema=_SCHEMA)


class Model:
    """Counts of trusted text by shard, files of the shared folder, and what joins need to know of all of them."""

    def __init__(self, parts: DataFrame, tables: frozenset, folder: str, shard_bits: int, filter_bits: int, stats: list) -> None:
        self.parts, self.tables, self.folder, self.shard_bits, self.filter_bits, self.stats = parts, tables, folder, shard_bits, filter_bits, stats

    def losses(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(key, tokens, loss) of each different text that has a word: key is its xxhash64, tokens its words and its end, loss the
        sum of their negative log chances."""
        shard_bits, folder, filter_bits, stats, tables = self.shard_bits, self.folder, self.filter_bits, self.stats, self.tables

        def ask(f: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            bits, (frequent, values), part, number = _filter(folder, f, shard_bits, filter_bits), _head(folder)[f], TaskContext.get().partitionId(), 0

            def known(keys: np.ndarray) -> np.ndarray:
                spot = _place(keys, shard_bits, filter_bits)
                return bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 1

            for syms, sizes, keys in blocks(batches, "key"):
                after = np.append(syms[1:], np.uint32(0))
                # Pieces of BLOCK symbols at most; a block is some pieces, one after the other.
                many = -(-sizes // BLOCK)
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = (np.cumsum(sizes) - sizes)[doc] + piece * BLOCK
                size = np.minimum(sizes[doc] - piece * BLOCK, BLOCK)
                keys = keys[doc]
                names = (np.cumsum(size) - size) // BLOCK + np.arange(len(doc)) // 60_000 * len(doc)
                for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(names)) + 1) if len(doc) else []:
                    block, number = part << 32 | number, number + 1
                    span = slice(int(start[at[0]]), int(start[at[-1]] + size[at[-1]]))
                    who = np.repeat(np.arange(len(at), dtype=np.uint16), size[at])
                    here = syms[span]
                    words = here.astype(np.uint64) << np.uint64(32)
                    spot = np.minimum(np.searchsorted(frequent, here), max(0, len(frequent) - 1))
                    held = frequent[spot] == here if len(frequent) else np.zeros(len(here), bool)
                    sums = np.bincount(who[held], values[spot[held]], len(at))
                    yield _rows([("docs", f, block % (1 << shard_bits), block, pack(keys[at]), pack(piece[at].astype(np.int32)), bundle(pack(size[at].astype(np.int32)), pack(sums)), None)])
                    hit = known(words | ALONE) & ~held
                    one, n = _counted(np.sort(words[hit] >> np.uint64(16) | who[hit]))
                    yield _rows([("words", f, s, block, pack_lists((one[x] >> np.uint64(16)).astype(np.uint32), one[x].astype(np.uint16), n[x]), None, None, None) for s, x in _shards(one, shard_bits, 16)])
                    words |= after[span]
                    hit = known(words)
                    pairs, who = words[hit], who[hit]
                    order = np.argsort(pairs, kind="stable")
                    pairs, who = pairs[order], who[order]
                    new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (who[1:] != who[:-1])))) if len(pairs) else np.zeros(0, np.int64)
                    n = np.diff(np.append(new, len(pairs))).astype(np.uint32)
                    pairs, who = pairs[new], who[new]
                    yield _rows([("pairs", f, s, block, pack_lists(pairs[x], who[x], n[x]), None, None, None) for s, x in _shards(pairs, shard_bits, 32)])

        def answer(got: pd.DataFrame) -> pd.DataFrame:
            """Shares of a shard's words and pairs in the documents' losses, added by document."""
            out = [("docs", f, 0, block, a, b, c, None) for f, block, a, b, c in got.loc[got["kind"] == "docs", ["fold", "block", "a", "b", "c"]].itertuples(index=False)]
            fold, shard = int(got["fold"].iloc[0]), int(got["shard"].iloc[0])
            d1, types, unseen, d2 = stats[fold]
            by = {k: x for k, x in got.groupby("kind")}

            def words_of(kind: str) -> tuple[np.ndarray, np.ndarray]:
                parts = [(unpack(a, np.uint32, True), unpack(b, np.uint32)) for a, b in zip(by[kind]["a"], by[kind]["b"])]
                w, n = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(w)
                return w[order], n[order].astype(np.int64)

            own, value, keys, gain = np.zeros(0, np.uint32), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
            if f"{fold}-{shard}" in tables:
                keys, n, heads, at, each = _shard_counts(folder, fold, shard)
                total = np.add.reduceat(n, at)
                weight = np.add.reduceat(d2[np.minimum(n, 3)], at) / total
                lw, ln = words_of("lower")
                ln = ln[np.searchsorted(lw, (keys & ALONE).astype(np.uint32))]
                low = (ln - d1[np.minimum(ln, 3)]) / types + unseen
                gain = np.log1p((n - d2[np.minimum(n, 3)]) / np.repeat(total, each) / (np.repeat(weight, each) * low))
                own, un = words_of("uni")
                value = _word_values(own, un, heads, weight, stats[fold])
            shares: dict[int, tuple] = {}

            def add(block: int, who: np.ndarray, x: np.ndarray) -> None:
                one, back = np.unique(who, return_inverse=True)
                shares.setdefault(block, []).append((one.astype(np.uint16), np.bincount(back, x, len(one))))

            for kind, table, values, size in (("words", own, value, np.uint32), ("pairs", keys, gain, np.uint64)):
                if kind in by:
                    for block, raw in by[kind][["block", "a"]].itertuples(index=False):
                        asked, many, who, times = unpack_lists(raw, size)
                        add(block, who, np.repeat(_found(table, values, asked), many) * times)
            for block, parts in shares.items():
                for who, x in parts:
                    out.append(("share", fold, shard, block, pack(who), pack(x.astype(np.float32)), None, None))
            del by, got, keys, gain, own, value
            trim()
            return pd.DataFrame(out, columns=_COLUMNS)

        def total(got: pd.DataFrame) -> pd.DataFrame:
            """The losses of a block's documents."""
            (fold, a, b, c), = got.loc[got["kind"] == "docs", ["fold", "a", "b", "c"]].itertuples(index=False)
            size, sums = unbundle(c)
            keys, piece, size, sums = unpack(a, np.int64), unpack(b, np.int32), unpack(size, np.int32), unpack(sums, np.float64).copy()
            shares = got[got["kind"] == "share"]
            for who, x in sorted(zip(shares["a"], shares["b"])):  # in one order, whatever the order they came in
                sums[unpack(who, np.uint16)] += unpack(x, np.float32)
            return pd.DataFrame({"key": keys, "piece": piece, "tokens": size, "loss": -size * np.log(stats[int(fold)][2]) - sums})

        texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), fold_of(F.col(text_col)).alias("fold"))
        each = None
        for f in range(FOLDS):  # one after the other: what travels for a fold is gone before the next one's does
            asked = texts.where(F.col("fold") == f).mapInArrow(partial(ask, f), _ROW)
            answered = asked.unionByName(self.parts.where(F.col("fold") == f)).groupBy("fold", "shard").applyInPandas(answer, _ROW)
            own = cut(answered.groupBy("block").applyInPandas(total, "key long, piece int, tokens int, loss double"))
            each = own if each is None else each.unionByName(own)
        # Copies of a text have the same pieces; each counts once.
        once = each.groupBy("key", "piece").agg(F.max("tokens").alias("tokens"), F.max("loss").alias("loss"))
        return once.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The Model of all texts of `docs`: each fold's is counted from the texts of the other fold."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shard_bits = max(0, min(20, int(np.ceil(np.log2(max(1, size / SHARD_BYTES))))))
    filter_bits = max(shard_bits + 3, min(FILTER_BITS, int(np.ceil(np.log2(max(8, size))))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for syms, sizes, folds in blocks(batches, "fold"):
            keys, folds = _pairs(syms), np.repeat(folds, sizes)
            for f in range(FOLDS):
                own = keys[folds == (f + 1) % FOLDS]
                for at in range(0, len(own), 2 * BLOCK):
                    one, n = _counted(np.sort(own[at : at + 2 * BLOCK]))
                    yield _rows([("count", f, s, 0, pack(one[x], True), pack(n[x].astype(np.uint32)), None, None) for s, x in _shards(one, shard_bits, 32)])

    folder = fresh_dir(spark, "quality")

    def gather(got: pd.DataFrame) -> pd.DataFrame:
        """The sums of a shard, how many contexts each word has in it, and its part of the filter."""
        keys = np.concatenate([unpack(a, np.uint64, True) for a in got["a"]])
        n = np.concatenate([unpack(b, np.uint32) for b in got["b"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[at], np.add.reduceat(n, at)
        fold, shard = int(got["fold"].iloc[0]), int(got["shard"].iloc[0])
        bits = np.zeros(max(8, 1 << filter_bits >> shard_bits), np.uint8)
        heads = keys & ~ALONE
        for some in (keys, heads[np.concatenate(([True], heads[1:] != heads[:-1]))] | ALONE):
            bits[(_place(some, shard_bits, filter_bits) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        name = put(folder, f"{fold}-{shard}", np.packbits(bits, bitorder="little").tobytes())
        put(folder, f"{name}.counts", bundle(pack(keys, True), pack(np.minimum(n, 2**32 - 1).astype(np.uint32))))
        out = [("table", fold, shard, 0, None, None, name.encode(), _few(n))]
        words, many = _counted(np.sort(keys & np.uint64(0xFFFFFFFF)))
        out += [("words", fold, s, shard, pack(words[x].astype(np.uint32), True), pack(many[x].astype(np.uint32)), None, None) for s, x in _shards(words, shard_bits, 0)]
        del got, keys, n, order, at, bits, heads
        trim()
        return pd.DataFrame(out, columns=_COLUMNS)

    def lower(got: pd.DataFrame) -> pd.DataFrame:
        """How many contexts each word of a shard has in all, told to each shard that asked."""
        parts = [(unpack(a, np.uint32, True), unpack(b, np.uint32)) for a, b in zip(got["a"], got["b"])]
        words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([m for _, m in parts])).astype(np.int64)
        fold, shard = int(got["fold"].iloc[0]), int(got["shard"].iloc[0])
        out = [("uni", fold, shard, 0, pack(words, True), pack(n.astype(np.uint32)), None, [*_few(n), int(n.sum()), len(n)])]
        out += [("lower", fold, int(to), 0, pack(w, True), pack(n[np.searchsorted(words, w)].astype(np.uint32)), None, None) for to, (w, _) in zip(got["block"], parts)]
        return pd.DataFrame(out, columns=_COLUMNS)

    counted = docs.select(F.col(text_col).alias("text"), fold_of(F.col(text_col)).alias("fold")).mapInArrow(count, _ROW)
    tables = cut(counted.groupBy("fold", "shard").applyInPandas(gather, _ROW))
    del counted
    release(spark)
    named = cut(tables.where("kind = 'words'").groupBy("fold", "shard").applyInPandas(lower, _ROW))
    few = {r["fold"]: [r[f"n{k}"] for k in range(4)] for r in tables.where("kind = 'table'").groupBy("fold").agg(*[F.sum(F.col("few")[k]).alias(f"n{k}") for k in range(4)]).collect()}
    uni = {r["fold"]: [r[f"n{k}"] for k in range(6)] for r in named.where("kind = 'uni'").groupBy("fold").agg(*[F.sum(F.col("few")[k]).alias(f"n{k}") for k in range(6)]).collect()}
    stats = []
    for f in range(FOLDS):
        *ns, types, words = uni.get(f, [0] * 6)
        d1 = discounts(*ns)
        # What discounts take from words' chances, shared by all words and one more, which stands for unseen ones.
        taken = d1[1] * ns[0] + d1[2] * ns[1] + d1[3] * (words - ns[0] - ns[1])
        stats.append((d1, max(1, types), (taken / types if types else 1.0) / (words + 1), discounts(*few.get(f, [0] * 4))))

    def head(got: pd.DataFrame) -> pd.DataFrame:
        """Values of a shard's most frequent words."""
        fold, shard = int(got["fold"].iloc[0]), int(got["shard"].iloc[0])
        words, n = unpack(got["a"].iloc[0], np.uint32, True), unpack(got["b"].iloc[0], np.uint32).astype(np.int64)
        _, counts, heads, at, _ = _shard_counts(folder, fold, shard)
        total = np.add.reduceat(counts, at)
        value = _word_values(words, n, heads, np.add.reduceat(stats[fold][3][np.minimum(counts, 3)], at) / total, stats[fold])
        most = np.sort(np.argsort(-_found(heads, total, words), kind="stable")[: max(1, HEAD_WORDS >> shard_bits)])
        return pd.DataFrame([("head", fold, shard, 0, pack(words[most], True), pack(value[most]), None, None)], columns=_COLUMNS)

    got = named.where("kind = 'uni'").groupBy("fold", "shard").applyInPandas(head, _ROW).select("fold", "shard", "a", "b").collect()  # HEAD_WORDS a fold, about
    folds = []
    for f in range(FOLDS):
        mine = sorted((r["shard"], bytes(r["a"]), bytes(r["b"])) for r in got if r["fold"] == f)
        words = [unpack(a, np.uint32, True) for _, a, _ in mine] or [np.zeros(0, np.uint32)]
        values = [unpack(b, np.float64) for _, _, b in mine] or [np.zeros(0)]
        folds.append(bundle(pack(np.concatenate(words), True), pack(np.concatenate(values))))
    put(folder, "head", bundle(*folds))
    names = [bytes(r["c"]).decode() for r in tables.where("kind = 'table'").select("c").collect()]  # a name a shard
    put(folder, "names", " ".join(sorted(names)).encode())
    return Model(named.withColumn("few", F.lit(None).cast("array<long>")), frozenset(names), folder, shard_bits, filter_bits, stats)


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, key, tokens, perplexity, smoothed, low, threshold, keep) for each row of `docs`."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    trusted = docs.join(ids, docs[id_col] == ids["trusted_id"], "left_semi")
    losses = fit(trusted, text_col).losses(docs, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"))
    own = cut(own.join(losses, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))))
    known = own.join(ids, own["doc_id"] == ids["trusted_id"], "left_semi").where("tokens > 0")
    mean = known.agg(F.sum("loss") / F.sum("tokens")).first()[0] or 0.0
    smoothed = F.exp((F.coalesce("loss", F.lit(0.0)) + PRIOR_TOKENS * mean) / (F.col("tokens") + PRIOR_TOKENS))
    limits = lambda: [F.percentile_approx(smoothed, BELOW, 100_000).alias("low"), F.percentile_approx(smoothed, 1 - ABOVE, 100_000).alias("threshold")]
    every = known.agg(*limits()).first()
    # A language without trusted rows has all trusted rows' thresholds.
    by_lang = known.groupBy("lang").agg(*limits())
    by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_IDS else by_lang
    found = own.join(by_lang.withColumnRenamed("lang", "known_lang"), F.col("lang").eqNullSafe(F.col("known_lang")), "left").drop("known_lang")
    for name in ("low", "threshold"):
        found = found.withColumn(name, F.coalesce(name, F.lit(every[name]).cast("double")))
    inside = F.coalesce((smoothed <= F.col("threshold")) & (smoothed >= F.col("low")), F.lit(True))
    perplexity = F.when(F.col("tokens") > 0, F.exp(F.col("loss") / F.col("tokens")))
    return found.select("doc_id", "lang", "key", F.col("tokens").cast("long").alias("tokens"), perplexity.alias("perplexity"), smoothed.alias("smoothed"), "low", "threshold", ((F.col("tokens") > 0) & inside).alias("keep"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, tokens, perplexity, smoothed, low, threshold, keep) for each row of `docs`.

    A text is kept if its perplexity, smoothed by PRIOR_TOKENS tokens of average trusted text, lies between its
    language's two thresholds: junk lies above, a few words over and over below. Null, empty and blank texts have no perplexity
    and aren't kept. A null language is a language by itself; a language without trusted texts has the
    thresholds of all. Equal texts of a language are judged alike; repeated rows appear again; without trusted rows there is
    no threshold and every text with a token is kept; an empty table gives no rows; other columns are ignored.
    """
    return _judged(docs, labels, id_col, text_col, lang_col).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that judge() keeps. Texts aren't shuffled where few are rejected."""
    bad = cut(_judged(docs, labels, "doc_id", "text", "lang").where(~F.col("keep")).select(F.col("key").alias("bad_key"), F.col("lang").alias("bad_lang")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    same = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_key"]) & docs["lang"].eqNullSafe(bad["bad_lang"])
    return docs.join(bad, same, "left_anti")
