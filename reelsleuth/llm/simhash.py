"""SimHash near-duplicates: fingerprints, and exact links by vantage-point trees.

Two fingerprints within `radius` bits of each other differ by at most radius // 2 bits in one of their
halves. A vantage-point tree for each half therefore has to be searched at that smaller radius only,
and every pair that it offers is checked on all 64 bits.

Near copies by likeness (near_copies) need more bits: at a Jaccard similarity of 0.8 a sixth of a fingerprint's bits differ. Theirs
have 256, in BANDS bands of BAND_BITS with a tree each, searched at radius 1; every pair is checked on all bits, and then on its
shingles. Pairs that fingerprints miss are found by their rarest shingles, so that none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, trim
from .components import connected_components
from .quality import _mixed, slices, symbols

RADIUS = 3
#: Fingerprints that live in one leaf, about; a leaf with twice as many is searched in tiles.
LEAF = 2048
#: Fingerprints that the driver draws to place vantage points: so many a leaf, and at most so many.
SAMPLE_PER_LEAF, SAMPLE_MOST = 48, 1 << 19
#: (column, bits) that a tree lives on.
HALVES = ((0, np.uint64(0xFFFFFFFF00000000)), (0, np.uint64(0x00000000FFFFFFFF)))
#: Columns of 64 bits of a wide fingerprint, and its bands: three to a column.
LANES, BAND_BITS = 4, 20
BANDS = tuple((lane, np.uint64(((1 << BAND_BITS) - 1) << (BAND_BITS * k))) for lane in range(LANES) for k in range(3))


def simhash64(text: str | None, words_each: int = 3) -> int:
    """64-bit SimHash of the word shingles of `text`, ASCII letters lower-cased, as an unsigned number.

    Fewer words than a shingle holds make one shingle; no words, or null, make 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = len(words) - words_each + 1
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[:count].tolist(), ends[words_each - 1 :].tolist())), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 8192):
        block = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    found = np.fromiter((simhash64(t) for t in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. One pass, no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprint(F.col(text_col)).alias("fp"))


class Tree:
    """A balanced vantage-point tree over one half of the bits, kept as flat arrays.

    Node i has the children 2i+1 (distance to the vantage point at most `bound`) and 2i+2. Its size
    follows the depth alone, and the depth is at most 14.
    """

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int) -> None:
        self.mask, self.depth = mask, depth
        inner = (1 << depth) - 1
        self.point, self.bound = np.zeros(inner, np.uint64), np.full(inner, -1, np.int16)
        if depth:
            self._place(np.unique(sample & mask), 0, np.random.default_rng(1))

    def _place(self, left: np.ndarray, node: int, rng: np.random.Generator) -> None:
        if node >= len(self.point) or len(left) == 0:
            return
        best = None
        for v in rng.choice(left, min(6, len(left)), replace=False):
            far = np.bitwise_count(left ^ v).astype(np.int16)
            m = int(np.median(far))
            # an even split with few fingerprints at the boundary
            cost = abs(2 * int((far <= m).sum()) - len(left)) + int(((far == m) | (far == m + 1)).sum())
            if best is None or cost < best[0]:
                best = (cost, v, m, far)
        _, self.point[node], self.bound[node], far = best
        self._place(left[far <= self.bound[node]], 2 * node + 1, rng)
        self._place(left[far > self.bound[node]], 2 * node + 2, rng)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for the leaf where each fingerprint lives and each leaf that it visits.

        Of two fingerprints within the radius, one visits the leaf where the other lives, or they share
        it: by the triangle inequality their distances to a vantage point differ by the radius at most.
        """
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            far = np.bitwise_count((fps[row] & self.mask) ^ self.point[node]).astype(np.int16)
            bound = self.bound[node]
            inside = far <= bound
            near_in, near_out = np.where(home, inside, far <= bound + radius), np.where(home, ~inside, far > bound - radius)
            visit = home & inside & (far > bound - radius)
            row, home, node = (
                np.concatenate((row[near_in], row[near_out], row[visit])),
                np.concatenate((home[near_in], home[near_out], np.zeros(int(visit.sum()), bool))),
                np.concatenate((2 * node[near_in] + 1, 2 * node[near_out] + 2, 2 * node[visit] + 2)),
            )
        return row, node, home


def leaf_edges(fps: np.ndarray, home: np.ndarray, radius: int, band: tuple[int, np.uint64] = HALVES[0], near: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as rows, of the links between the homes and all fingerprints (n, columns) of a leaf.

    Linked are those that differ by `near` bits at most in the tree's band and by `radius` in all. Of a clique only as many
    links leave as it has members, so no square of a group's size is ever emitted.
    """
    own, at, label, out = fps[:, band[0]] & band[1], np.flatnonzero(home), np.arange(len(fps)), []
    for i in range(0, len(at), 128):
        rows = at[i : i + 128]
        r, c = (np.bitwise_count(own[rows, None] ^ own[None, :]) <= near).nonzero()
        some = rows[r] != c
        r, c = r[some], c[some]
        close = np.zeros(len(r), np.int16)
        for k in range(fps.shape[1]):
            close += np.bitwise_count(fps[rows[r], k] ^ fps[c, k])
        r, c = r[close <= radius], c[close <= radius]
        for k, first, last in zip(*(x.tolist() for x in _runs(r))):
            row, others = rows[k], c[first:last]
            labels, one = np.unique(label[others], return_index=True)
            new = labels != label[row]
            if new.any():
                out += [(row, j) for j in others[one[new]]]
                label[np.isin(label, labels)] = min(labels.min(), label[row])
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return a, b


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, last) of the runs of equal values in a sorted array."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[first], first, np.append(first[1:], len(x))


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF, columns: tuple[str, ...] = ("fp",), bands: tuple = HALVES, near: int | None = None) -> DataFrame:
    """(a, b): links between the nodes of `distinct` (node, columns), enough of them to join each group of links.

    Two nodes link that differ by `radius` bits at most, and in some band by `near` at most; near is radius // 2 for two
    halves, where no link is lost. Pairs are exact. `distinct` must hold each
    fingerprint once. The driver keeps at most SAMPLE_MOST fingerprints, to place vantage points.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = min(14, max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
    some = min(SAMPLE_MOST, SAMPLE_PER_LEAF << depth) if depth else 0
    drawn = distinct.orderBy(F.xxhash64(*columns), *columns).limit(some).collect() if some else []
    sample = np.array([[r[c] for c in columns] for r in drawn], np.int64).reshape(-1, len(columns)).view(np.uint64)
    trees = [Tree(sample[:, column], mask, depth) for column, mask in bands]
    near = radius // 2 if near is None else near

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.iloc[at : at + 20_000]
                for i, (tree, (column, _)) in enumerate(zip(trees, bands)):
                    row, node, home = tree.route(part[columns[column]].to_numpy().view(np.uint64), near)
                    yield part.iloc[row].assign(leaf=node * len(trees) + i, home=home)[["leaf", "home", "node", *columns]]

    fps = ", ".join(f"{c} long" for c in columns)
    placed = distinct.select("node", *columns).mapInPandas(route, f"leaf long, home boolean, node long, {fps}")
    # A leaf with too many homes is searched in tiles: each has some of its homes and all that is in it.
    tiles = placed.where("home").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).cast("int").alias("tiles"))
    many = {r["leaf"]: r["tiles"] for r in tiles.where("tiles > 1").collect()}  # at most as many as leaves
    if many:
        few = spark.createDataFrame([(k, v) for k, v in many.items()], "leaf long, tiles int")
        placed = placed.join(F.broadcast(few), "leaf", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        placed = placed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        placed = placed.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("node"), F.col("tiles")) == F.col("tile")))
    else:
        placed = placed.withColumn("tile", F.lit(0))

    def search(got: pd.DataFrame) -> pd.DataFrame:
        fps, nodes = got[list(columns)].to_numpy().view(np.uint64), got["node"].to_numpy()
        a, b = leaf_edges(fps, got["home"].to_numpy(), radius, bands[int(got["leaf"].iloc[0]) % len(bands)], near)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return placed.groupBy("leaf", "tile").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`.

    component_id is the smallest doc_id that links reach, the row's own included; links join fingerprints
    that differ by `radius` bits at most. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows appear again; a null doc_id stays null and names no component unless all are null.
    Other columns are ignored; an empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))).withColumn("node", F.col("fp"))
    named = _components(distinct, links(distinct, radius)).withColumnRenamed("node", "fp")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(distinct: DataFrame, edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, component_id): of (node, first_id) and links, the smallest first_id of each node's component."""
    roots = connected_components(edges, few=few).withColumnRenamed("node", "linked")
    by_node = distinct.join(roots, distinct["node"] == roots["linked"], "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = by_node.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return by_node.join(least, "root").select("node", "component_id")


#: Bits of a shingle's hash.
SHINGLE_BITS = 44
#: Shingles that one task counts, about.
SHARD = 2_000_000
#: Columns of 64 bits that mark a set's shared shingles, each flipping one; a power of two.
MARKS = tuple(f"mark{k}" for k in range(8))
#: Pairs a text beyond which pivots are tried before all pairs of a shared shingle are, but of so many texts at least.
MANY_PAIRS, FEW_TEXTS, TURNS = 4, 20_000, 8
#: Links that the driver joins by itself (16 bytes each); more are joined by the executors.
FEW_EDGES = 200_000


def _shingled(texts: pa.Array, words_each: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, owner, heads, tails, hashes) of some texts at once, about 50,000 shingles: the different shingles of the
    text first + owner[i], ASCII letters lower-cased, are hashes[heads[i]:tails[i]]. Texts without words have none.
    """
    syms, sizes = symbols(texts, lower=True)
    first = np.cumsum(sizes) - sizes + 1  # after the symbol that begins a text
    many = np.where(sizes > 0, np.maximum(sizes - words_each, 1), 0)
    weights = _mixed(np.arange(1, words_each + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    at = 0
    while at < len(sizes):
        stop = at + max(1, int(np.searchsorted(np.cumsum(many[at : at + 50_000]), 50_000, "right")))
        doc = np.repeat(np.arange(stop - at), many[at:stop])
        if len(doc):
            place = np.arange(len(doc)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop]) + first[at:stop][doc]
            end = (first + sizes - 1)[at:stop][doc]
            h = np.zeros(len(doc), np.uint64)
            for k in range(words_each):
                h += np.where(place + k < end, syms[np.minimum(place + k, len(syms) - 1)], 0).astype(np.uint64) * weights[k]
            one = np.sort(doc.astype(np.uint64) << np.uint64(SHINGLE_BITS) | _mixed(h) >> np.uint64(64 - SHINGLE_BITS))
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
            owner, heads, tails = _runs((one >> np.uint64(SHINGLE_BITS)).astype(np.int64))
            yield at, owner, heads, tails, one & np.uint64((1 << SHINGLE_BITS) - 1)
        at = stop


def wide_fingerprints(texts: pa.Array, words_each: int) -> np.ndarray:
    """(n, LANES): 64 x LANES bits of SimHash over the different word shingles of each text, ASCII letters lower-cased.

    Fewer words than a shingle holds make one shingle; no words make zeros.
    """
    return _wide(texts, words_each)[0]


def _wide(texts: pa.Array, words_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wide fingerprints, a hash of the set of shingles, and how many different ones there are."""
    out, keys, n = np.zeros((len(texts), LANES), np.uint64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    for at, owner, heads, tails, one in _shingled(texts, words_each):
        half = (tails - heads)[:, None]
        n[at + owner] = tails - heads
        keys[at + owner] = _mixed(np.add.reduceat(_mixed(one + np.uint64(9 << 48)), heads) ^ (tails - heads).astype(np.uint64))
        for lane in range(LANES):
            for s, e, rows in _slices(heads, tails, 65_536):
                bits = np.unpackbits(_mixed(one[s:e] + np.uint64(lane + 1 << 48)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, heads[rows] - s, axis=0, dtype=np.int32)
                packed = np.packbits(2 * ones > half[rows], axis=1)
                out[at + owner[rows], lane] = packed.view(">u8")[:, 0]
    return out, keys, n


def _slices(heads: np.ndarray, tails: np.ndarray, size: int) -> Iterator[tuple[int, int, slice]]:
    """(first, last, runs) of neighbouring runs of about `size` places, a longer run by itself."""
    k = 0
    while k < len(heads):
        stop = max(k + 1, int(np.searchsorted(tails, heads[k] + size, "right")))
        yield int(heads[k]), int(tails[stop - 1]), slice(k, stop)
        k = stop


def radius_of(similarity: float, bits: int = 64 * LANES) -> int:
    """Bits by which two texts of equally many shingles and this Jaccard similarity differ, on average, and a deviation more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


def _blocks(nodes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, block) of shingles' hashes and of the nodes that hold them, owner[i] being the place of its node."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    for k, first, last in zip(*(x.tolist() for x in _runs(shard[order]))):
        rows = order[first:last]
        some, at = np.unique(owner[rows], return_inverse=True)
        h = hashes[rows]
        yield k, b"".join((np.array([len(rows), len(some)], np.uint32).tobytes(), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (h >> np.uint64(32)).astype(np.uint16).tobytes(), at.astype(np.uint16).tobytes(), nodes[some].tobytes()))


def _unblocked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, nodes) of a block, one row a shingle."""
    m, d = np.frombuffer(block, np.uint32, 2).tolist()
    low, high, at = np.frombuffer(block, np.uint32, m, 8), np.frombuffer(block, np.uint16, m, 8 + 4 * m), np.frombuffer(block, np.uint16, m, 8 + 6 * m)
    return low | high.astype(np.uint64) << np.uint64(32), np.frombuffer(block, np.int64, d, 8 + 8 * m)[at]


def shared_shingles(docs: DataFrame, words_each: int, shards: int) -> DataFrame:
    """(node, shared): of each different set of shingles in `docs` (text), those that another set holds too, in some rows.

    A shingle is its hash, and above that in how many sets it is, so that rarer ones sort first. Each set counts once.
    """
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for b in batches for x in slices(b, 4_000_000) for y in (x.slice(k, 60_000) for k in range(0, len(x), 60_000))):
            nodes, owners, hashes = np.zeros(len(batch), np.int64), [], []
            for at, owner, heads, tails, one in _shingled(batch.column("text"), words_each):
                nodes[at + owner] = _mixed(np.add.reduceat(_mixed(one + np.uint64(9 << 48)), heads) ^ (tails - heads).astype(np.uint64)).view(np.int64)
                owners.append(np.repeat(at + owner, tails - heads))
                hashes.append(one)
            if not hashes:
                continue
            owner, one = np.concatenate(owners), np.concatenate(hashes)
            held = nodes[np.unique(owner)]
            fresh = np.zeros(len(nodes), bool)  # copies within the batch go once
            fresh[np.unique(owner)[np.unique(held, return_index=True)[1]]] = True
            keep = fresh[owner]
            got = list(_blocks(nodes, owner[keep], one[keep], shards))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["shard", "block"])
        trim()

    def count(got: pa.Table) -> pa.Table:
        parts = [_unblocked(x.as_py()) for x in got.column("block")]
        h, node = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node = h[new], node[new]
        _, first, last = _runs(h)
        sets = np.repeat(last - first, last - first)
        node, value = node[sets > 1], (np.minimum(sets, (1 << 18) - 1).astype(np.uint64) << np.uint64(SHINGLE_BITS) | h)[sets > 1].view(np.int64)
        order = np.argsort(node, kind="stable")
        value = value[order]
        key, first, last = _runs(node[order])
        del parts, h, node, order, new, sets
        trim()
        return pa.table({"node": pa.array(key), "shared": pa.ListArray.from_arrays(pa.array(np.append(first, len(value)), pa.int32()), pa.array(value))})

    return docs.select("text").mapInArrow(give, "shard int, block binary").groupBy("shard").applyInArrow(count, "node long, shared array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those pairs whose sets of shingles are `similarity` alike; shingles that both hold are shared ones."""
    one, two = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("shared").alias(f"shared_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("shared_a", "shared_b")))
    return both.where(F.col("i") >= (F.col("n_a") + F.col("n_b") - F.col("i")) * similarity - 1e-9).select("a", "b")


def _classed(postings: DataFrame, edges: DataFrame) -> DataFrame:
    """Postings with the class that edges put their node into."""
    roots = connected_components(edges, few=FEW_EDGES).withColumnRenamed("node", "linked")
    return cut(postings.join(roots, postings["node"] == roots["linked"], "left").select(*postings.columns, F.coalesce("root", "node").alias("class")))


def _may_be_alike(similarity: float) -> Column:
    """False for pairs of rows _a and _b that can't be alike, by their sizes or by bits that only one of them has flipped.

    Alike sets differ in (1 - similarity) / (1 + similarity) of their sizes' sum at most. They differ in the shingles that no other set holds,
    and in one shared one at least for each bit that differs in their marks.
    """
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9
    differ = F.col("n_a") - F.col("held_a") + F.col("n_b") - F.col("held_b")
    for mark in MARKS:
        differ += F.bit_count(F.col(f"{mark}_a").bitwiseXOR(F.col(f"{mark}_b")))
    return sizes & (differ <= (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def likeness_links(sets: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """(a, b): `edges`, all of which are alike, and enough other pairs of `similarity` or more to join all such pairs.

    `sets` is (node, n, shared): shared shingles, the rarest first. Of two sets that are alike, each holds one of the other's among its
    first n - ceil(similarity n) + 1, in any order common to all; those that no other set holds come before, and need no look.
    Only pairs of different classes meet, that may be alike by their sizes and marks, and where enough shingles follow in both: at the first
    that both hold, all others that they share do. Where very many would meet, each shingle's pivot meets the others first, which joins what is much alike,
    until that joins nothing twice.
    """
    least, held = F.ceil(F.col("n") * similarity - 1e-9), F.size("shared")
    marks = [F.expr(f"aggregate(shared, 0L, (x, v) -> x ^ if((shiftright(v, 6) & {len(MARKS) - 1}) = {k}, shiftleft(1L, cast(v & 63 as int)), 0L))").alias(m) for k, m in enumerate(MARKS)]
    marked = cut(sets.select("node", "n", held.alias("held"), *marks, F.slice("shared", F.lit(1), (held - least + 1).cast("int")).alias("first")))  # cut, as Spark would mark each exploded row anew
    postings = cut(marked.select("node", "n", "held", *MARKS, F.posexplode("first").alias("at", "token")))
    total = max(sets.count(), FEW_TEXTS)
    stuck = 0
    for turn in range(TURNS + 1):
        classed = _classed(postings, edges)
        own = [x for x in classed.columns if x != "token"]
        x, y = (classed.select("token", *[F.col(c).alias(f"{c}_{k}") for c in own]) for k in "ab")
        follow = F.least(F.col("held_a") - F.col("at_a"), F.col("held_b") - F.col("at_b")) >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-6
        met = x.join(y, "token").where((F.col("class_a") < F.col("class_b")) & follow & _may_be_alike(similarity))
        if turn == TURNS or stuck == 2 or met.count() <= MANY_PAIRS * total:
            return edges.unionByName(_alike(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), sets, similarity))
        pivots = classed.groupBy("token").agg(F.min_by(F.struct(*own), F.xxhash64("node", F.lit(turn))).alias("p")).select("token", *[F.col(f"p.{c}").alias(f"{c}_a") for c in own])
        starred = pivots.join(y, "token").where((F.col("class_a") != F.col("class_b")) & _may_be_alike(similarity))
        more = cut(_alike(starred.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), sets, similarity))
        stuck, edges = stuck + 1 if more.isEmpty() else 0, edges.unionByName(more)


def near_copies(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_key, component_id) for each row of `docs`: groups of texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

    Links are exact, but for hashes of shingles that collide: those that wide SimHash offers are checked on the sets, and those
    that it misses are found by rare shingles. component_id is the smallest doc_id that links reach. Null and empty texts are one group.
    Repeated rows appear again; a null doc_id stays null and names no component unless all are null; an empty table gives no rows;
    other columns are ignored.
    """
    columns = [f"f{k}" for k in range(LANES)]
    keyed = docs.select("doc_id", F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 4_000_000)):
            fps, keys, n = _wide(batch.column("text"), words_each)
            fps = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(fps[:, k]) for k in range(LANES)), pa.array(keys.view(np.int64)), pa.array(n)], names=["doc_id", "text_key", *columns, "node", "n"])

    schema = keyed.select("doc_id", "text_key").schema
    for c in (*columns, "node", "n"):
        schema = schema.add(c, T.LongType())
    own = cut(keyed.mapInArrow(each, schema))
    distinct = cut(own.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in columns]))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    shared = shared_shingles(docs, words_each, max(1, -(-total // SHARD))).groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("shared"))).alias("shared"))
    # A text that shares too few shingles with all others together is like none of them.
    sets = cut(distinct.join(shared, "node").where(F.size("shared") >= F.ceil(F.col("n") * similarity - 1e-9)).select("node", "n", "shared", *columns))
    fps = cut(sets.groupBy(*columns).agg(F.min("node").alias("node")))
    same = sets.select(F.col("node").alias("b"), *columns).join(fps.withColumnRenamed("node", "a"), columns).where("a <> b").select("a", "b")
    offered = links(fps, radius_of(similarity), LEAF, tuple(columns), BANDS, 1).unionByName(same)
    offered = offered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # several bands offer the same
    sets = sets.select("node", "n", "shared")
    edges = likeness_links(sets, cut(_alike(offered, sets, similarity)), similarity)
    named = _components(distinct, edges, FEW_EDGES)
    return own.join(named, "node").select("doc_id", "text_key", "component_id")


def one_of_each(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their group of near_copies(): those with its smallest doc_id.

    Rows that repeat a doc_id and its text count once. Rows without a doc_id stay only if their whole component has none.
    """
    named = near_copies(docs, words_each, similarity)
    kept = cut(named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("n")))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if kept.where("n > 1").limit(1).count() else rows
