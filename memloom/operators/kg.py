"""The temporal knowledge graph: as-of predicates, walks, merges and upserts over facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import written

ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"


def _key(c: Column, clock: str) -> Column:
    return F.when(F.length(c) == 10, F.concat(c, F.lit(f"T{clock}.000000Z"))).when(F.length(c) == 20, F.concat(F.substring(c, 1, 19), F.lit(".000000Z"))).otherwise(c)


def start_key(c: Column) -> Column:
    """A date as its first second and all times to the microsecond, so that they compare as text."""
    return _key(c, "00:00:00")


def end_key(c: Column) -> Column:
    """The same with a date as its last second."""
    return _key(c, "23:59:59")


def iso_or_null(c: Column) -> Column:
    """Values in one of the two standard forms that are real times; null for all else."""
    return F.when(c.rlike(ISO) & F.try_to_timestamp(F.substring(c, 1, 10)).isNotNull(), c)


def utc_or_null(norm: Column) -> Column:
    """A time as ``timestamps.normalised`` gives it, whole seconds without fraction; null where it is unknown or has two
    readings."""
    return F.when(~norm.isin("none", "ambiguous"), F.regexp_replace(norm, r"\.000000Z$", "Z"))


def as_of(t: str) -> Column:
    """Facts whose period (valid_from, valid_to; null is open) holds the time ``t``."""
    at, to = (t + "T00:00:00.000000Z", t + "T23:59:59.999999Z") if len(t) == 10 else 2 * (t[:19] + ".000000Z" if len(t) == 20 else t,)
    f, u = F.col("valid_from"), F.col("valid_to")
    return (f.isNull() | (start_key(f) <= F.lit(to))) & (u.isNull() | (end_key(u) >= F.lit(at)))


def about(facts: DataFrame, name: str, direction: str = "both", t: str | None = None) -> DataFrame:
    """Relations of an entity with ``direction`` and ``current``; a loop is both outgoing and incoming."""
    f = facts if t is None else facts.where(as_of(t))
    sides = {"outgoing": "subject", "incoming": "object"}
    picked = [f.where(F.col(c) == name).withColumn("direction", F.lit(d)) for d, c in sides.items() if direction in (d, "both")]
    return reduce(DataFrame.unionByName, picked).withColumn("current", F.col("valid_to").isNull())


def walk(facts: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """Entities within ``hops`` of ``start``: (entity, hop, via, source); of several ways the first hop counts, then
    outgoing before incoming, then the least (source, via)."""
    steps = facts.select(F.col("subject").alias("a"), F.col("predicate").alias("via"), F.col("object").alias("b"), F.lit(0).alias("back"))
    steps = steps.unionByName(facts.select(F.col("object").alias("a"), F.concat("predicate", F.lit(" (inverse)")).alias("via"), F.col("subject").alias("b"), F.lit(1).alias("back"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    spark = facts.sparkSession
    seen = spark.createDataFrame([(start, 0, None, None)], "entity string, hop int, via string, source string")
    edge = seen
    for hop in range(1, hops + 1):
        near = steps.join(edge.select(F.col("entity").alias("a")), "a").join(seen.select(F.col("entity").alias("b")), "b", "left_anti")
        first = F.min(F.struct("back", F.col("a").alias("source"), "via")).alias("r")
        edge = written(near.groupBy(F.col("b").alias("entity")).agg(first).select("entity", F.lit(hop).alias("hop"), "r.via", "r.source"))
        seen = seen.unionByName(edge)
    return seen.where("hop > 0")


def merged(facts: DataFrame, source: str, target: str) -> DataFrame:
    """Facts with one entity renamed to another, without the loops that this makes, each once."""
    to = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c)).alias(c)
    f = facts.select(to("subject"), "predicate", to("object"), "valid_from", "valid_to")
    return f.where(~((F.col("subject") == target) & (F.col("object") == target))).distinct()


def resolved(aliases: DataFrame, most: int = 10) -> DataFrame:
    """The end of each chain alias -> canonical: (alias, canonical, steps); chains are cut at ``most`` steps, so a ring
    ends. One target counts for an alias, the least."""
    one = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical")).where("alias <> canonical")
    at = one.withColumn("steps", F.lit(1))
    for _ in range(most - 1):
        nxt = at.join(one.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further")), "canonical", "left")
        nxt = written(nxt.select("alias", F.coalesce("further", "canonical").alias("canonical"), (F.col("steps") + F.col("further").isNotNull().cast("int")).alias("steps"), F.col("further").isNotNull().alias("moved")))
        at = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            break
    return at


def upsert_triples(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` with ``new`` (subject, predicate, object, valid_from, valid_to, confidence): an open fact on the same
    triple takes over the new values, other triples are added. Of several new rows for a triple the latest
    (valid_from, valid_to) counts; rows that end before they begin are left out."""
    ok = new.where(F.col("valid_to").isNull() | F.col("valid_from").isNull() | (end_key(F.col("valid_to")) >= start_key(F.col("valid_from"))))
    keys = ["subject", "predicate", "object"]
    last = ok.groupBy(*keys).agg(F.max(F.struct(start_key(F.col("valid_from")).alias("fk"), end_key(F.col("valid_to")).alias("tk"), F.coalesce("valid_from", F.lit("")).alias("f"), F.coalesce("valid_to", F.lit("")).alias("t"), "confidence")).alias("r"))
    last = last.select(*keys, F.nullif("r.f", F.lit("")).alias("new_from"), F.nullif("r.t", F.lit("")).alias("new_to"), F.col("r.confidence").alias("new_confidence"))
    opened, closed = facts.where("valid_to IS NULL"), facts.where("valid_to IS NOT NULL")
    hit = F.col("new_confidence").isNotNull()
    both = opened.withColumn("old", F.lit(True)).join(last, keys, "full").select(*keys, F.coalesce("new_from", "valid_from").alias("valid_from"), F.coalesce("new_to", "valid_to").alias("valid_to"), F.coalesce("new_confidence", "confidence").alias("confidence"), F.when(F.col("old").isNull(), "added").when(hit, "updated").otherwise("kept").alias("change"))
    return both.unionByName(closed.select(*keys, "valid_from", "valid_to", "confidence", F.lit("kept").alias("change")))


def checked(triples: DataFrame, batch: str, least: float = 0.0) -> DataFrame:
    """(batch, triples, bad, accepted) for every batch: a triple is bad if one of its names is blank or its confidence is not between
    ``least`` and 1; a batch with a bad triple is refused as a whole."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank("subject") | blank("predicate") | blank("object") | F.coalesce(~F.col("confidence").between(least, 1), F.lit(False))
    n = triples.groupBy(batch).agg(F.count(F.lit(1)).alias("triples"), F.sum(bad.cast("long")).alias("bad"))
    return n.withColumn("accepted", F.when(F.col("bad") == 0, F.col("triples")).otherwise(0))


def invalidate(facts: DataFrame, gone: Column, day: str) -> DataFrame:
    """Open facts that ``gone`` holds for end on ``day``, unless they begin later."""
    hit = F.col("valid_to").isNull() & gone & (F.col("valid_from").isNull() | (start_key(F.col("valid_from")) <= F.lit(day + "T23:59:59.999999Z")))
    return facts.withColumn("valid_to", F.when(hit, F.lit(day)).otherwise(F.col("valid_to")))


def near_names(names: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of distinct names at edit distance 1 or 2.

    ``names``: name; null takes no part. Names meet where they are equal after up to two deletions on either side, which holds
    for every pair within two edits; no other block is used. A name of n letters gives (n + 1)(n + 2) / 2 keys.
    """
    cut = lambda s, i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s)))
    n = F.length("a")
    # Position n + 1 stands for no deletion.
    keys = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(F.sequence(i, n + 1), lambda j: F.xxhash64(F.when(i == j, cut(F.col("a"), j)).otherwise(cut(cut(F.col("a"), j), i))))))
    k = written(names.select(F.col("name").alias("a")).where("a IS NOT NULL").distinct().select("a", F.explode(F.array_distinct(keys)).alias("k")))
    pairs = k.join(k.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", 2).between(1, 2))


#: Claims in texts, with the groups that hold subject, role and object.
CLAIMS = (
    (r"(?U)\b([A-Z][\w-]+)\s+is\s+([A-Z][\w-]+)'s\s+([a-z]{3,20})\b", (1, 3, 2)),
    (r"(?U)\b([A-Z][\w-]+)'s\s+([a-z]{3,20})\s+is\s+([A-Z][\w-]+)\b", (3, 2, 1)),
    (r"([\p{L}]+) (replaced|contradicts|follows|covers) the ([a-z]+ [a-z]+)", (1, 2, 3)),
)


def claims_of(texts: DataFrame) -> DataFrame:
    """(id, subject, claimed, object) of the claims "A is B's role", "B's role is A" and "A <verb> the B" in ``texts`` (id,
    content); ``claimed`` is the role or verb in lower case, names are as written."""
    found = [F.arrays_zip(*(F.regexp_extract_all("content", F.lit(p), F.lit(g)).alias(k) for k, g in zip(("subject", "claimed", "object"), groups, strict=True))) for p, groups in CLAIMS]
    return texts.where("content IS NOT NULL").select("id", F.explode(F.concat(*found)).alias("c")).select("id", "c.subject", F.lower("c.claimed").alias("claimed"), "c.object")


def contradicted(claims: DataFrame, facts: DataFrame, day: str) -> DataFrame:
    """(id, subject, object, claimed, held, valid_to, problem) of the claims that facts of the same subject and object speak
    against: ``relationship_mismatch`` for each other predicate that holds on ``day``, ``stale_fact`` for the claimed one if a
    period of it ended before (valid_to: the last such end)."""
    end = F.col("valid_to")
    over = F.coalesce(end_key(end) < F.lit(day + "T00:00:00.000000Z"), F.lit(False))
    # A row for each predicate of a pair, however many facts there are.
    held = facts.where("predicate IS NOT NULL").groupBy("subject", "object", F.col("predicate").alias("held")).agg(F.bool_or(~over).alias("current"), F.max(F.when(over, F.struct(end_key(end), "valid_to")))["valid_to"].alias("ended"))
    m = claims.join(held, ["subject", "object"])
    same = F.col("held") == F.col("claimed")
    problem = F.when(same & F.col("ended").isNotNull(), "stale_fact").when(~same & F.col("current"), "relationship_mismatch")
    return m.select("id", "subject", "object", "claimed", "held", F.when(same, F.col("ended")).alias("valid_to"), problem.alias("problem")).where("problem IS NOT NULL")
