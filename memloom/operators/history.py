"""History of changing attributes from periodic snapshots, by comparing Merkle trees.

A snapshot is a table of statements (key, value, from, to). Keys are hashed into leaf buckets; the digest of a
leaf is an order-free sum of row hashes, the digest of an inner node hashes its children. Two snapshots are
compared from the root down: only nodes whose digests differ are descended into. For the leaf buckets that
changed, versions are derived again and compared with the recorded ones; new ones are appended, versions that
no longer hold are marked as retired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators.timestamps import adapters, normalised_all, us_text
from memloom.session import small, table, written

KEYS = ["subject", "predicate"]
#: log2 of the children of a node.
FAN_BITS = 8
#: Rows that a leaf holds on average: few, so that a leaf seldom changes for another key's sake.
LEAF_ROWS = 2
#: Rows of one key that a single window may hold; larger keys are cut into stretches of time.
KEY_ROWS = 100_000
SECOND = 1_000_000


def leaf_bits(rows: int) -> int:
    """Bits of the leaf number: about LEAF_ROWS rows a leaf."""
    return max(FAN_BITS, (rows // LEAF_ROWS).bit_length())


def _halves(h: Column) -> list[Column]:
    """A hash as two numbers of 32 bits."""
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def _sums(h: Column) -> list[Column]:
    # As decimals the sums of halves can't overflow, however many rows a leaf has; what counts is their remainder.
    whole = lambda c: F.pmod(F.sum(c.cast("decimal(20,0)")), F.lit(2**61 - 1)).cast("long")
    lo, hi = _halves(h)
    return [whole(lo).alias("lo"), whole(hi).alias("hi"), F.count(F.lit(1)).alias("n")]


def leaf_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*KEYS), 64 - bits)


def leaves(snapshot: DataFrame) -> DataFrame:
    """Digests of the leaf buckets of a snapshot that has a ``leaf`` column: (leaf, lo, hi, n)."""
    row = F.xxhash64(*KEYS, "id", "object", "start", "end")
    return snapshot.groupBy("leaf").agg(*_sums(row))


def parents(nodes: DataFrame) -> DataFrame:
    """Digests one level up."""
    return nodes.groupBy(F.shiftrightunsigned("leaf", FAN_BITS).alias("leaf")).agg(*_sums(F.xxhash64("leaf", "lo", "hi", "n")))


def tree(snapshot: DataFrame, bits: int) -> list[DataFrame]:
    """Digests of a snapshot by level, leaves first, root last. The leaves are written; the levels above, each smaller by
    the factor 2^FAN_BITS, are sums over them."""
    levels = [written(leaves(snapshot))]
    for _ in range(-(-bits // FAN_BITS)):
        levels.append(parents(levels[-1]))
    return levels


def descended(old: list[DataFrame], new: list[DataFrame]) -> list[DataFrame]:
    """The nodes (leaf) of each level, root first, that differ and whose parents differ: the way from the root down to
    the changed leaves. Only children of differing nodes are compared."""
    out: list[DataFrame] = []
    for a, b in reversed(list(zip(old, new, strict=True))):
        if out:
            up = out[-1].select(F.col("leaf").alias("up"))
            a, b = (x.join(up, F.shiftrightunsigned("leaf", FAN_BITS) == F.col("up"), "left_semi") for x in (a, b))
        a = a.select("leaf", F.struct("lo", "hi", "n").alias("a"))
        b = b.select("leaf", F.struct("lo", "hi", "n").alias("b"))
        out.append(a.join(b, "leaf", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("leaf"))
    return out


def changed_leaves(old: list[DataFrame], new: list[DataFrame]) -> DataFrame:
    """Leaf numbers whose buckets differ, found by descending from the root into differing nodes only."""
    return written(descended(old, new)[-1])


def with_neighbours(rows: DataFrame, keys: list[str], order: str, before: list[str], after: list[str], key_rows: int | None = KEY_ROWS) -> DataFrame:
    """Adds ``prev_c`` for c in ``before`` and ``next_c`` for c in ``after``: the values of the rows before and
    after in the order of ``order`` (unique within a key) among the rows of one key; null at the ends.

    A key with more than ``key_rows`` rows is cut at quantiles of ``order`` into stretches that are windows of
    their own; the last and first rows of neighbouring stretches are handed over, so no task sorts a whole key.
    ``key_rows`` None: the caller knows that no key is so large.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    near = lambda w: [F.lag(c).over(w).alias(f"prev_{c}") for c in before] + [F.lead(c).over(w).alias(f"next_{c}") for c in after]
    heavy = None if key_rows is None else rows.groupBy(*keys).count().where(F.col("count") > key_rows)
    if heavy is None or heavy.isEmpty():
        return rows.select("*", *near(w))
    heavy = written(heavy)
    pieces = int(heavy.agg(F.max("count")).first()[0] // key_rows + 1)
    cuts = rows.join(small(heavy.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], min(2**31 - 1, 100 * pieces)).alias("_cuts"))
    cut = rows.join(small(written(cuts)), keys, "left").withColumn("_seg", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))).drop("_cuts")
    cut = written(cut.withColumn("_seg", F.when(F.col("_seg") < 0, 0).otherwise(F.col("_seg"))))
    cols = list(dict.fromkeys([*keys, order, *before, *after]))
    pick = lambda f: cut.groupBy(*keys, "_seg").agg(f(F.struct(*(c for c in cols if c not in keys)), F.col(order)).alias("r"))
    kw = Window.partitionBy(*keys).orderBy("_seg")
    last = pick(F.max_by).withColumn("_seg", F.lead("_seg").over(kw)).where("_seg IS NOT NULL")
    first = pick(F.min_by).withColumn("_seg", F.lag("_seg").over(kw)).where("_seg IS NOT NULL")
    carried = reduce(DataFrame.unionByName, [x.select(*keys, "_seg", "r.*", F.lit(True).alias("_carried")) for x in (last, first)])
    both = cut.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    sw = Window.partitionBy(*keys, "_seg").orderBy(order)
    return both.select("*", *near(sw)).where(~F.col("_carried")).drop("_seg", "_carried")


def versions(rows: DataFrame, key_rows: int | None = KEY_ROWS) -> DataFrame:
    """Versions (leaf, subject, predicate, object, starts, ends) of statements with unique (key, start).

    Going by start, a row continues the version before it if the object is the same and the end of the row
    before is open or at most a second before the row's start. ``ends`` is the earlier of the version's own end
    and the next version's start, or null. ``starts`` and ``ends`` are microseconds.
    """
    near = with_neighbours(rows, KEYS, "start", ["object", "end", "start"], ["start"], key_rows)
    goes_on = (F.col("object") == F.col("prev_object")) & (F.col("prev_end").isNull() | (F.col("prev_end") >= F.col("start") - SECOND))
    is_new = F.col("prev_start").isNull() | ~goes_on
    marks = near.withColumn("is_new", is_new).where(F.col("is_new") | F.col("next_start").isNull())
    # A mark after a new version's is the start of the next version, with the end of the row before it, or this version's last row.
    marks = marks.select("leaf", *KEYS, "object", "start", "end", "is_new", F.when(F.col("is_new"), F.col("prev_end")).otherwise(F.col("end")).alias("closes"))
    near = with_neighbours(marks, KEYS, "start", [], ["start", "is_new", "closes"], key_rows)
    own = F.when(F.col("next_start").isNull(), F.col("end")).otherwise(F.col("next_closes"))
    follows = F.when(F.col("next_is_new"), F.col("next_start"))
    return near.where("is_new").select("leaf", *KEYS, "object", F.col("start").alias("starts"), F.least(own, follows).alias("ends"))


def latest_per_start(rows: DataFrame) -> DataFrame:
    """Of the rows of a key with the same start, the one with the largest id."""
    one = F.max(F.struct("id", "object", "end")).alias("r")
    return rows.groupBy("leaf", *KEYS, "start").agg(one).select("leaf", *KEYS, "start", "r.id", "r.object", "r.end")


def apply_snapshot(history: DataFrame | None, old_tree: list[DataFrame] | None, snapshot: DataFrame, number: int, bits: int, key_rows: int | None = KEY_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """Brings ``history`` up to ``snapshot``; returns the new history and the tree to compare with next time.

    ``history`` holds every version that any snapshot gave: ``seen`` is the number of the snapshot that added it,
    ``retired`` that of the one that no longer has it (null: it holds). ``snapshot`` has the columns leaf, subject,
    predicate, id, object, start, end. An empty snapshot retires every version.
    """
    new_tree = tree(snapshot, bits)
    changed = new_tree[0].select("leaf") if old_tree is None else changed_leaves(old_tree, new_tree)
    now = versions(latest_per_start(snapshot.join(changed, "leaf", "left_semi")), key_rows)
    if history is None:
        return written(now.withColumn("seen", F.lit(number)).withColumn("retired", F.lit(None).cast("int"))), new_tree
    cols = ["leaf", *KEYS, "object", "starts", "ends"]
    current = history.where("retired IS NULL").join(changed, "leaf", "left_semi")
    both = current.select(*cols, F.col("seen")).unionByName(now.withColumn("seen", F.lit(None).cast("int")))
    merged = both.groupBy(*cols).agg(F.max("seen").alias("seen"), F.max(F.col("seen").isNull()).alias("holds"))
    merged = merged.select(*cols, F.coalesce("seen", F.lit(number)).alias("seen"), F.when(~F.col("holds"), number).cast("int").alias("retired"))
    untouched = history.where("retired IS NULL").join(changed, "leaf", "left_anti").unionByName(history.where("retired IS NOT NULL"))
    return written(untouched.unionByName(merged)), new_tree


def history_of(rows: DataFrame, periods: int = 3, key_rows: int = KEY_ROWS) -> DataFrame:
    """History from snapshots taken at ``periods`` quantiles of ``arrived`` (text that sorts by time; null counts
    as first): each snapshot holds what had arrived by then.

    ``rows``: subject, predicate, object, id, start, end, arrived. Rows with a null key, object or start take no
    part; repeated rows count once; an empty table gives an empty history.
    """
    rows = rows.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND start IS NOT NULL")
    rows = written(rows.select("subject", "predicate", "object", "id", "start", "end", F.coalesce(F.unix_seconds(F.try_to_timestamp("arrived")), F.lit(0).cast("long")).alias("arrived")))
    n, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx("arrived", [i / periods for i in range(1, periods)] or [1.0])).first()
    bits = leaf_bits(n)
    largest = rows.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
    key_rows = None if largest <= key_rows else key_rows  # snapshots and versions have no more rows
    rows = rows.withColumn("leaf", leaf_of(bits))
    history = digests = None
    for k, cut in enumerate([*sorted(set(cuts or [])), None], 1):
        snapshot = rows if cut is None else rows.where(F.col("arrived") <= cut)
        history, digests = apply_snapshot(history, digests, snapshot.drop("arrived"), k, bits, key_rows)
    return history


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts on single-valued predicates with known start, spelled evenly, times in microseconds."""
    f = table(spark, sf_dir, "facts")
    even = lambda c: F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))
    predicate = F.replace(F.lower("predicate"), F.lit(" "), F.lit("_"))
    single = table(spark, sf_dir, "predicates").where("single_valued").select(F.col("predicate").alias("p")).distinct()
    f = f.join(single, predicate == F.col("p"), "left_semi")
    a = adapters(spark, sf_dir)
    f = f.join(a, "adapter_name", "left")
    base = f.select("id", even("subject").alias("subject"), predicate.alias("predicate"), even("object").alias("object"), "valid_from", "valid_to", "created_at", "tz", "date_order")
    n = normalised_all(base, ["valid_from", "valid_to"], "tz", "date_order").where("valid_from_us IS NOT NULL").withColumnRenamed("valid_from_us", "start")
    end = F.when(F.col("valid_to_is_date"), F.col("valid_to_us") + (86_400 - 1) * SECOND).otherwise(F.col("valid_to_us"))
    n = n.select("subject", "predicate", "object", "id", "start", end.alias("end"), F.col("created_at").alias("arrived"))
    return n.where(F.col("end").isNull() | (F.col("end") >= F.col("start")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that hold after the last snapshot, as text."""
    h = history_of(statements(spark, sf_dir)).where("retired IS NULL")
    return h.select("subject", "predicate", "object", us_text(F.col("starts")).alias("starts"), F.coalesce(us_text(F.col("ends")), F.lit("")).alias("ends")).distinct()


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, also retired ones, with the snapshots that added and retired them."""
    h = history_of(statements(spark, sf_dir))
    return h.select("subject", "predicate", "object", us_text(F.col("starts")).alias("starts"), us_text(F.col("ends")).alias("ends"), "seen", "retired")
