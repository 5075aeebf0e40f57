"""Sharding by Karmarkar-Karp differencing: indivisible groups into shards of nearly equal bytes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Groups that one task differences, about.
GROUPS_PER_TASK = 20_000
#: Partial partitions that one task, or the driver at the end, combines; so the driver holds FAN x shards sums at most.
FAN = 1024
#: Rows of a shard that are numbered together, about.
ROWS_PER_PART = 200_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Which of k bins each item of `sizes` goes to.

    `sizes` is n x k: each row is a partial partition (a single item has one size and zeros). The two with
    the largest spread are combined, the largest sums of one with the smallest of the other, until one
    is left. Returns n x k: the bin of each column of each row. Ties go by the order of the rows.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros((0, k), np.int64)
    sums: list = [None] * (2 * n - 1)
    order: list = [None] * (2 * n - 1)  # of the columns, by falling sum
    kids: list = [None] * (2 * n - 1)
    heap = []
    for i in range(n):
        o = np.argsort(-sizes[i], kind="stable")
        sums[i], order[i] = sizes[i][o], o
        heap.append((-int(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    nxt = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        o = np.argsort(-both, kind="stable")
        sums[nxt], order[nxt], kids[nxt] = both[o], o, (a, b)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both[o[0]] - both[o[-1]]), nxt))
        nxt += 1
    # From the root down: the bin of each sorted column of a node.
    place: list = [None] * nxt
    place[nxt - 1] = np.arange(k)
    for i in range(nxt - 1, n - 1, -1):
        unsorted = np.empty(k, np.int64)
        unsorted[order[i]] = place[i]
        a, b = kids[i]
        place[a], place[b] = unsorted, unsorted[::-1]
        place[i] = order[i] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): all rows, equal texts together, bytes near equal.

    size is the UTF-8 length of the text (null: 0) plus `overhead`. Equal texts form a group that is never split; null texts are one
    group and empty ones another, so a group larger than a shard's share makes a shard of its own.
    Tasks difference about GROUPS_PER_TASK groups each into `shards` partial sums; their sums are combined by
    the same rule, FAN at a time, the last FAN by the driver. slot numbers a shard's rows from 0 by a hash of
    doc_id, then doc_id. Repeated rows each get a slot; a null doc_id is a row like others; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.sha2(text_col, 256), F.lit("")).alias("group"),
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    seen = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    tasks, parts = max(1, -(-seen["groups"] // GROUPS_PER_TASK)), max(1, -(-(seen["rows"] or 0) // (shards * ROWS_PER_PART)))

    def part(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("group", ignore_index=True)
        sizes = np.zeros((len(got), shards), np.int64)
        sizes[:, 0] = got["bytes"]
        return got.assign(bin=differencing(sizes, shards)[:, 0])[["group", "task", "bytes", "bin"]]

    dealt = groups.select("group", "bytes").withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)).cast("int"))
    placed = cut(dealt.groupBy("task").applyInPandas(part, "group string, task int, bytes long, bin long"))
    sums = placed.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes"))
    final = _combine(sums, tasks, shards)
    by_group = placed.join(F.broadcast(final) if tasks <= FAN else final, ["task", "bin"]).select("group", "shard")
    own = cut(rows.join(by_group, "group").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("part")))
    return _slots(own).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _combine(sums: DataFrame, tasks: int, shards: int) -> DataFrame:
    """(task, bin, shard): the shard of each column of the partial partitions in (task, bin, bytes)."""
    spark = sums.sparkSession

    def dense(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        names, row = np.unique(got["task"].to_numpy(), return_inverse=True)
        out = np.zeros((len(names), shards), np.int64)
        out[row, got["bin"].to_numpy()] = got["bytes"].to_numpy()
        return names, out

    if tasks <= FAN:
        names, sizes = dense(sums.toPandas())
        final = [(int(t), b, int(s)) for t, row in zip(names, differencing(sizes, shards)) for b, s in enumerate(row)]
        return spark.createDataFrame(final, "task int, bin long, shard int")

    def level(got: pd.DataFrame) -> pd.DataFrame:
        names, sizes = dense(got)
        placed = differencing(sizes, shards)
        return pd.DataFrame({"task": np.repeat(names, shards), "bin": np.tile(np.arange(shards), len(names)), "up": np.repeat(names // FAN, shards), "up_bin": placed.ravel(), "bytes": sizes.ravel()})

    up = cut(sums.withColumn("up", F.floor(F.col("task") / FAN)).groupBy("up").applyInPandas(level, "task int, bin long, up int, up_bin long, bytes long"))
    above = up.groupBy(F.col("up").alias("task"), F.col("up_bin").alias("bin")).agg(F.sum("bytes").alias("bytes"))
    named = _combine(above, -(-tasks // FAN), shards).select(F.col("task").alias("up"), F.col("bin").alias("up_bin"), "shard")
    return up.join(named, ["up", "up_bin"]).select("task", "bin", "shard")


def _slots(own: DataFrame) -> DataFrame:
    """Adds slot: numbers within (shard, part), after the rows of the shard's parts before."""
    from pyspark.sql import Window

    counts = own.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each part
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(F.broadcast(before.drop("n")), ["shard", "part"]).withColumn("slot", (F.col("at") + F.col("before")).cast("long"))
