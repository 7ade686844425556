"""Near-duplicate texts by Hamming search under the generalised pigeonhole principle.

Each text becomes a code of ``UNITS`` min-hash units of 32 bits of its three-word sequences, so that keys of two units seldom meet by chance. The bits of one unit change
together, so units stay whole when the code is cut into partitions. A threshold is allotted to each partition:
with t_1 + ... + t_m = t - m + 1, two codes that differ in at most t units differ in at most t_i units in
some partition i. Which partitions get which threshold is found by dynamic programming on candidate counts,
estimated over all codes by a signed sketch. Each partition is probed with every way to leave out t_i units;
what meets is compared bit by bit on a finer code and at last exactly.

Exact copies are one class before anything is paired; links are followed by label propagation over classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.words import word_hashes
from memloom.llm.arrays import distinct, flat, mixed, shingles
from memloom.operators import graph
from memloom.session import table, written

SIZE = 3  # words in a sequence
LEAST_WORDS = 20
SIMILARITY = 0.6
PARTS, PER_PART, UNITS, FINE = 6, 4, 24, 64
#: Units in which two codes may differ and still be sure to meet; pairs farther apart meet with a high chance.
RADIUS = 2 * PARTS - 1
#: Of the 128 bits of the finer code, as many may differ: 3.6 standard deviations above what similarity 0.6 gives.
FINE_BITS = 45
CELLS = 512


def _factors() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, FINE, dtype=np.uint64) | np.uint64(1)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = _factors()
    for b in batches:
        words, offsets = flat(b.column("w"))
        h, row = distinct(*shingles(words, offsets, SIZE))
        n = b.num_rows
        starts = np.searchsorted(row, np.arange(n))
        cls = mixed(np.add.reduceat(mixed(h), starts) + np.diff(np.append(starts, len(h))).astype(np.uint64))
        fine = np.zeros((n, 2), np.uint64)
        units = np.empty((n, UNITS), np.uint32)
        for k in range(FINE):
            least = np.minimum.reduceat((h * a[k]) >> np.uint64(16), starts)
            least = mixed(least)
            if k < UNITS:
                units[:, k] = (least >> np.uint64(32)).astype(np.uint32)
            fine[:, k // 32] |= (least & np.uint64(3)) << np.uint64(2 * (k % 32))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(cls.view(np.int64)), pa.array(fine[:, 0].view(np.int64)), pa.array(fine[:, 1].view(np.int64)), pa.array([r.tobytes() for r in units], pa.binary())],
            ["id", "cls", "f0", "f1", "units"],
        )


def part_keys(units: np.ndarray, part: int, left_out: int) -> np.ndarray:
    """Keys of one partition of codes: one column for each way to leave out ``left_out`` of its units."""
    u = units[:, part * PER_PART : (part + 1) * PER_PART].astype(np.uint64)
    out = []
    for keep in combinations(range(PER_PART), PER_PART - left_out):
        h = np.full(len(u), 1 + part * 64 + sum(1 << k for k in keep), np.uint64)
        for k in keep:
            h = mixed(h * np.uint64(5) + u[:, k])
        out.append(h)
    return np.stack(out, 1)


def _unpacked(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("units").to_pylist()), np.uint32).reshape(-1, UNITS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((PARTS, PER_PART - 1, CELLS))
    for b in batches:
        u = _unpacked(b)
        for p in range(PARTS):
            for t in range(PER_PART - 1):
                k = part_keys(u, p, t).ravel()
                np.add.at(sums[p, t], (k % np.uint64(CELLS)).astype(int), np.where(k >> np.uint64(63), 1.0, -1.0))
    p, t, c = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int32)) for x in (p, t, c)] + [pa.array(sums.ravel())], ["part", "t", "cell", "v"])


def allot(costs: np.ndarray, radius: int) -> list[int]:
    """Thresholds t_i >= -1 (-1: not probed) of least total cost with sum(t_i + 1) = radius + 1, by dynamic
    programming. ``costs[i, t]``: estimated candidates of partition i at threshold t."""
    need, parts = radius + 1, len(costs)
    best = [(0.0, [])] + [(np.inf, [])] * need
    for i in range(parts):
        best = [min(((best[s - k][0] + (costs[i, k - 1] if k else 0.0), best[s - k][1] + [k - 1]) for k in range(min(s, costs.shape[1]) + 1)), key=lambda x: x[0]) for s in range(need + 1)]
    return best[need][1]


def _probes(thresholds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unpacked(b)
            keys = np.concatenate([part_keys(u, p, t) for p, t in enumerate(thresholds) if t >= 0], 1)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))] + [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("cls", "f0", "f1")], ["key", "cls", "f0", "f1"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, row = distinct(*shingles(*flat(b.column("w")), SIZE))
        small, row = distinct(h >> np.uint64(32), row)
        ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.ListArray.from_arrays(pa.array(ends), pa.array(small.astype(np.uint32).view(np.int32)))], ["cls", "s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for edges (a, b)."""
    return graph.components(edges).withColumnRenamed("component", "label")


def near_duplicates(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Groups of near-duplicate texts: (id, cls, label), a row for every distinct id whose text has at least
    ``LEAST_WORDS`` words; ``cls`` is the class of equal sequence sets, ``label`` that of the group.

    Two texts belong together if their sets of distinct ``SIZE``-word sequences have a Jaccard similarity of at
    least ``SIMILARITY``; groups follow through shared members. Null, empty and short texts take no part, an
    empty table gives no rows, ids delivered several times count once, other columns are ignored.
    """
    base = df.select(F.col(key).alias("id"), word_hashes(F.col(text)).alias("w")).where(F.col("id").isNotNull() & (F.size("w") >= LEAST_WORDS))
    coded = written(base.mapInArrow(_codes, "id string, cls long, f0 long, f1 long, units binary"))
    classes = written(coded.groupBy("cls").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("units").alias("units"), F.min("id").alias("id")))
    sums = classes.select("units").mapInArrow(_sketch, "part int, t int, cell int, v double").groupBy("part", "t", "cell").agg(F.sum("v").alias("v"))
    costs = np.zeros((PARTS, PER_PART - 1))
    for p, t, v in sums.groupBy("part", "t").agg(F.sum(F.col("v") * F.col("v"))).collect():
        costs[p, t] = v
    probes = classes.mapInArrow(_probes(allot(costs, RADIUS)), "key long, cls long, f0 long, f1 long")
    x, y = (probes.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "f0", "f1"))) for s in "xy")
    apart = F.bit_count(F.col("f0_x").bitwiseXOR(F.col("f0_y"))) + F.bit_count(F.col("f1_x").bitwiseXOR(F.col("f1_y")))
    pairs = written(x.join(y, "key").where((F.col("cls_x") < F.col("cls_y")) & (apart <= FINE_BITS)).select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct())
    # Exactly: the sequence sets of the classes that met, as 32-bit numbers. One entity stands for each class.
    met = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    stand = classes.join(met, "cls", "left_semi").select("id", "cls")
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t")).join(stand, "id")
    sets = written(texts.select("cls", word_hashes(F.col("t")).alias("w")).mapInArrow(_sets, "cls long, s array<int>").dropDuplicates(["cls"]))
    j = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = written(j.where(both >= F.lit(SIMILARITY) * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    labels = components(links)
    members = coded.select("id", "cls").distinct()
    return members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("id", "cls", F.coalesce("label", "cls").alias("label"))


def group_pairs(groups: DataFrame, block: int = 64) -> DataFrame:
    """Pairs (id_a < id_b) within groups. A large group is cut into blocks of about ``block`` ids and its pairs of
    blocks are spread, so no task has more than two blocks of it at once."""
    sizes = groups.groupBy("label").agg(F.count_distinct("id").alias("n")).where("n > 1")
    g = groups.select("id", "label").distinct().join(sizes, "label").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    g = g.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    sides = F.transform(every, lambda o: F.struct(F.least("blk", o).alias("lo"), F.greatest("blk", o).alias("hi")))
    g = g.select("id", "label", "blk", F.explode(sides).alias("cell")).select("id", "label", "blk", "cell.lo", "cell.hi")
    a, b = (g.select(F.col("id").alias(f"id_{s}"), F.col("blk").alias(f"blk_{s}"), "label", "lo", "hi") for s in "ab")
    met = a.join(b, ["label", "lo", "hi"]).where(F.col("id_a") < F.col("id_b"))
    return met.where((F.col("lo") == F.col("hi")) | (F.col("blk_a") != F.col("blk_b"))).select("id_a", "id_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different entity ids in one group of near-duplicates: ``p1_groups`` written out, n (n - 1) / 2 rows for a group of n."""
    return group_pairs(near_duplicates(table(spark, sf_dir, "entities")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity with the class of its sequence set, its group (least id in it) and the group's size."""
    g = near_duplicates(table(spark, sf_dir, "entities"))
    of = g.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    return g.join(of, "label").select("id", F.hex("cls").alias("class_id"), "group_id", "members")
