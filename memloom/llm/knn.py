"""The most similar vectors of every vector, by multi-index hashing.

Unit vectors are rotated by principal axes and an iterative quantisation fitted on a bounded sample, and turned into binary codes.
A code is split into ``TABLES`` substrings, each with an index of its own. By the pigeonhole principle two codes within Hamming
distance TABLES * (r + 1) - 1 agree in some substring up to r bits, so each substring is probed within radius r = ``PROBE``; what
is met is ranked by the cosine of the floats.

The work is spread by cells: every vector is indexed in the cell of its nearest centroid (fitted on the same sample) and asks in the
nearest few, more of them the more cells there are. A cell's index holds all tables, so a vector travels once for each cell it asks
in, not once for each table. A cell with many rows is cut into several indexes and its queries into several blocks, so what a task
holds has a fixed bound. Equal vectors are one row of the index; their ids are put back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators.search import usable
from memloom.session import small, table, written

DIM, K = 384, 5
TABLES, PROBE, LOW_BITS = 4, 2, 12
SAMPLE, ROTATION_SAMPLE = 16_384, 4096  # rows that centroids and rotation are fitted on
CELL_ROWS, MOST_CELLS = 16_384, 4096
#: Indexed rows and queries that a task may hold.
TASK_ROWS, TASK_QUERIES = 262_144, 131_072
BLOCK = 1024  # queries in one matrix product


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """List column of vectors as a matrix; rows that can't be used are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = np.asarray(column.value_lengths().fill_null(-1)) == dim
    out = np.full((len(column), dim), np.nan, np.float32)
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.square(out, dtype=np.float64).sum(1))
        out /= np.where((norm > 0) & np.isfinite(norm), norm, np.nan)[:, None].astype(np.float32)
    return out


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 20) -> np.ndarray:
    """Projection to ``bits`` dimensions whose signs are the code: principal axes, then the rotation that brings the sample
    closest to its own signs."""
    if len(x) < 2:
        return np.eye(x.shape[1], bits, dtype=np.float32)
    _, axes = np.linalg.eigh(np.cov((x - x.mean(0)).T))
    rng = np.random.default_rng(4)
    axes = axes[:, ::-1][:, :bits]
    v = (x - x.mean(0)) @ axes
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return (axes @ rotation)[:, rng.permutation(bits)].astype(np.float32)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells."""
    rng = np.random.default_rng(6)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[k : k + 4096] @ c.T).argmax(1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), c)
    return c.astype(np.float32)


def asked_cells(cells: int) -> int:
    """In how many cells a vector asks."""
    return min(cells, max(2, math.ceil(math.log2(max(1, cells))) - 3))


def packed(unit: np.ndarray) -> np.ndarray:
    """Rows of numbers as 12 bits each: a byte for the upper eight, half a byte for the lower four."""
    n = np.rint(unit * (2047 / np.abs(unit).max(1, keepdims=True))).astype(np.int16) + 2048
    low = (n & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return np.concatenate([(n >> 4).astype(np.uint8), low[:, ::2] << 4 | low[:, 1::2]], 1)


def unpacked(rows: np.ndarray, dim: int) -> np.ndarray:
    """The numbers of ``packed``, whole."""
    low = np.stack([rows[:, dim:] >> 4, rows[:, dim:] & 15], 2).reshape(len(rows), -1)[:, :dim]
    return (rows[:, :dim].astype(np.int16) << 4 | low) - np.int16(2048)


def codes_of(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, low: int) -> np.ndarray:
    """Codes of unit vectors, ``low`` bits in a column for each table."""
    bits = ((x - mean) @ axes > 0).reshape(len(x), TABLES, -1)[:, :, :low]
    return bits @ (1 << np.arange(bits.shape[2]))


def search(x: np.ndarray, who: np.ndarray, held: np.ndarray, asks: np.ndarray, axes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row that asks, row met, cosine): the best ``k`` of the rows ``held`` that probing meets for each row of ``asks``.

    ``x``: whole numbers; ``who``: number of a row's id, which never meets itself. Thresholds of the code bits are the means of
    the held rows, so that they divide these evenly.
    """
    inverse = np.concatenate([1 / np.maximum(np.linalg.norm(x[a : a + 8192].astype(np.float32), axis=1), 1) for a in range(0, len(x), 8192)])
    mean = sum(((x[at].astype(np.float32) * inverse[at][:, None]).sum(0, dtype=np.float64) for at in np.array_split(held, len(held) // 8192 + 1)), 0) / len(held)
    low = min(axes.shape[1] // TABLES, max(2, round(math.log2(len(held) / 16)))) if len(held) > 16 else 2
    of = lambda rows: np.concatenate([codes_of(x[at].astype(np.float32) * inverse[at][:, None], mean.astype(np.float32), axes, low) for at in np.array_split(rows, len(rows) // 8192 + 1)])
    held_codes, ask_codes = of(held), of(asks)
    every = np.arange(1 << low)
    masks = every[np.bitwise_count(every) <= PROBE]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t in range(TABLES):
        h, q = np.argsort(held_codes[:, t], kind="stable"), np.argsort(ask_codes[:, t], kind="stable")
        mine, own = held[h], asks[q]
        edges = np.searchsorted(held_codes[h, t], np.arange((1 << low) + 1))
        bounds = np.searchsorted(ask_codes[q, t], np.arange((1 << low) + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            near = c ^ masks
            lo, hi = edges[near], edges[near + 1]
            full = hi > lo
            if not full.any():
                continue
            at = mine[np.concatenate([np.arange(a, b) for a, b in zip(lo[full], hi[full], strict=True)])]
            y = x[at].astype(np.float32).T
            y *= inverse[at]
            for b in range(bounds[c], bounds[c + 1], BLOCK):
                rows = own[b : min(b + BLOCK, bounds[c + 1])]
                cos = x[rows].astype(np.float32) @ y
                cos *= inverse[rows][:, None]
                cos[who[rows][:, None] == who[at][None, :]] = -2
                take = min(k, len(at))
                top = np.argpartition(-cos, take - 1, axis=1)[:, :take] if take < len(at) else np.broadcast_to(np.arange(take), (len(rows), take))
                best = np.take_along_axis(cos, top, 1)
                ok = best > -2
                out.append((np.repeat(rows, take).reshape(top.shape)[ok], at[top[ok]], best[ok]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    a, o, cos = (np.concatenate(z) for z in zip(*out, strict=True))
    order = np.lexsort((who[o], -cos, a))
    a, o, cos = a[order], o[order], cos[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (who[o[1:]] != who[o[:-1]])
    a, o, cos = a[fresh], o[fresh], cos[fresh]
    start = np.searchsorted(a, a)
    best = np.arange(len(a)) - start < k
    return a[best], o[best], cos[best]


def _search(axes, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        ids = t["id"].combine_chunks().dictionary_encode()
        who = ids.indices.to_numpy()
        indexed, asking = (t[c].to_numpy() for c in ("indexed", "asks"))
        v = t["v"].combine_chunks()
        del t
        x = unpacked(np.frombuffer(v.buffers()[2], np.uint8).reshape(len(v), -1), dim)
        once = lambda rows: rows[np.unique(who[rows], return_index=True)[1]]  # noqa: E731  (an id delivered twice stands once)
        held, asks = once(np.flatnonzero(indexed)), once(np.flatnonzero(asking))
        if not len(held) or not len(asks):
            return
        a, o, cos = search(x, who, held, asks, axes.value, k)
        rows, first = np.unique(a, return_index=True)
        ends = pa.array(np.append(first, len(a)).astype(np.int32))
        for lo in range(0, len(rows), 20_000):
            hi = min(lo + 20_000, len(rows))
            part = ends[lo : hi + 1]
            base = part[0].as_py()
            cut = slice(base, part[-1].as_py())
            at = pa.array(part.to_numpy() - base)
            yield pa.RecordBatch.from_arrays(
                [ids.dictionary.take(pa.array(who[rows[lo:hi]])), pa.ListArray.from_arrays(at, ids.dictionary.take(pa.array(who[o[cut]]))), pa.ListArray.from_arrays(at, pa.array(cos[cut]))], ["id", "others", "cos"]
            )

    return run


def _spread(base: DataFrame, rows: int, dim: int, k: int) -> DataFrame | None:
    """(id, others, cos): for every row of ``base`` (id, v) and each cell in which it asks the best rows met; None if there is no vector."""
    spark = base.sparkSession
    share = min(1.0, SAMPLE / max(1, rows))
    drawn = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, round(share * (1 << 20)))).limit(2 * SAMPLE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed(m[~np.isnan(m[:, 0])])], pa.binary())], ["v"])

    drawn = drawn.mapInArrow(pack, "v binary").toArrow()["v"].to_pylist()
    if not drawn:
        return None
    x = unpacked(np.frombuffer(b"".join(drawn), np.uint8).reshape(len(drawn), -1), dim).astype(np.float32)
    x = np.unique(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1), axis=0)
    x = x[np.random.default_rng(8).permutation(len(x))]
    centroids = fit_cells(x, min(MOST_CELLS, max(1, math.ceil(rows / CELL_ROWS))))
    axes = fit_rotation(x[:ROTATION_SAMPLE], min(dim // TABLES, LOW_BITS) * TABLES)
    cells, asked = len(centroids), asked_cells(len(centroids))
    centroids, axes = spark.sparkContext.broadcast(centroids), spark.sparkContext.broadcast(axes)

    def placed(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that can be used, their unit vectors, and the cells in which each asks, the nearest first."""
        m = matrix(v, dim)
        good = np.flatnonzero(~np.isnan(m[:, 0]))
        near = m[good] @ centroids.value.T
        top = np.argpartition(-near, asked - 1, axis=1)[:, :asked] if asked < cells else np.broadcast_to(np.arange(cells), near.shape)
        return good, m[good], np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asks = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            near = placed(b.column("v"))[2]
            held += np.bincount(near[:, 0], minlength=cells)
            asks += np.bincount(near.ravel(), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(held), pa.array(asks)], ["cell", "held", "asks"])

    splits, blocks = np.ones(cells, np.int64), np.ones(cells, np.int64)
    for c, held, asks in base.mapInArrow(count, "cell long, held long, asks long").groupBy("cell").agg(F.sum("held"), F.sum("asks")).collect():
        splits[c], blocks[c] = max(1, math.ceil(held / TASK_ROWS)), max(1, math.ceil(asks / TASK_QUERIES))
    first = np.concatenate([[0], np.cumsum(splits * blocks)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, unit, near = placed(b.column("v"))
            if not len(good):
                continue
            vs = np.array([r.tobytes() for r in packed(unit)], object)
            ids = b.column("id").take(pa.array(good))
            h = np.frombuffer(np.ascontiguousarray(unit[:, :4]).tobytes(), np.uint32).reshape(-1, 4).astype(np.int64) @ np.array([1, 3, 7, 31])
            for j in range(asked):
                cell = near[:, j]
                split, block = h % splits[cell], h // 1009 % blocks[cell]
                # All splits for the row's block of queries; of its own cell also all blocks for its split of the index.
                for s in range(int(splits[cell].max())):
                    for q in range(int(blocks[cell].max())) if j == 0 else (None,):
                        asks = (block == q) if q is not None else np.ones(len(cell), bool)
                        indexed = (split == s) & (j == 0)
                        to = np.flatnonzero((asks | indexed) & (s < splits[cell]) & (True if q is None else q < blocks[cell]))
                        if len(to):
                            part = first[cell[to]] + s * blocks[cell[to]] + (block[to] if q is None else q)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(to)), pa.array(part.astype(np.int32)), pa.array(indexed[to]), pa.array(asks[to]), pa.array(vs[to], pa.binary())], ["id", "part", "indexed", "asks", "v"])

    sent = base.mapInArrow(emit, "id string, part int, indexed boolean, asks boolean, v binary").repartitionById(int(first[-1]), "part")
    return sent.mapInArrow(_search(axes, dim, k), "id string, others array<string>, cos array<float>")


def nearest(df: DataFrame, key: str = "id", vector: str = "vector", dim: int = DIM, k: int = K) -> DataFrame:
    """(id, others ARRAY<STRING>): for every id with a usable vector the ids of the ``k`` vectors of highest cosine
    that the probes meet, best first (ties: larger id first).

    Vectors that are null, zero, not of ``dim`` numbers or hold nulls, NaN or infinities take no part. An id
    delivered several times is one id. Ids with equal vectors are nearest to each other. Fewer than k others are given
    where fewer are met; an id without any gives no row, nor does an empty table. Other columns are ignored.
    """
    v = F.col("v")
    base = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(v, dim) & F.forall(v, lambda x: F.abs(x) < F.lit(float("inf"))))
    keyed = base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # Ids that share a vector: the largest stands for them.
    shared = written(keyed.groupBy("h1", "h2").agg(F.max("id").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("least <> rep").drop("least"))
    few = small(shared)
    members = written(keyed.select("h1", "h2", "id").join(few, ["h1", "h2"]).select("id", "rep").distinct())
    alone = keyed.join(few, ["h1", "h2"], "left").where("rep IS NULL OR rep = id").select("id", "v")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("id")))
    # Of those that share a vector only the largest k + 1 can be among the best of any id.
    stand = written(members.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids")))
    met = _spread(alone, df.count(), dim, k)
    if met is None:
        met = df.sparkSession.createDataFrame([], "id string, others array<string>, cos array<float>")
    best = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("cos", "others"))), asc=False)), 1, k)
    near = met.groupBy("id").agg(best.alias("b")).select(F.col("id").alias("rep"), F.explode("b").alias("b")).select("rep", "b.cos", F.col("b.others").alias("other"))
    near = near.join(stand.withColumnRenamed("rep", "other"), "other", "left").select("rep", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cos")
    own = stand.select("rep", F.explode("ids").alias("other"), F.lit(2.0).cast("float").alias("cos"))  # before all others
    ranked = near.unionByName(own).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("cos", "other")), asc=False).alias("r"))
    named = ranked.join(members.select("rep", "id"), "rep", "left").withColumn("id", F.coalesce("id", "rep"))
    others = F.slice(F.filter(F.transform("r", lambda r: r["other"]), lambda o: o != F.col("id")), 1, k)
    return named.select("id", others.alias("others")).where(F.size("others") > 0).groupBy("id").agg(F.first("others").alias("others"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids of which at least one is among the five most similar of the other."""
    n = nearest(table(spark, sf_dir, "docs")).select("id", F.explode("others").alias("other"))
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
