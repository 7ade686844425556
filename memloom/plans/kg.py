"""Queries of the temporal knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import kg as K
from memloom.operators.timestamps import adapters, normalised_all
from memloom.plans.base import registry
from memloom.plans.times_sql import ADAPTERS, FACT_VALUES, MATCH, readings
from memloom.session import table, written
from memloom.sources.tables import WITH, entities, facts

QUERIES, SQL, query = registry()
HUB = "shared_memory_hub"
T = "2024-06-15"


def even(c: str):
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def spelled(spark: SparkSession, d: str) -> DataFrame:
    """Facts spelled evenly, with their periods as delivered."""
    return facts(spark, d).select("id", even("subject").alias("subject"), F.replace(F.lower("predicate"), F.lit(" "), F.lit("_")).alias("predicate"), even("object").alias("object"), "valid_from", "valid_to", "confidence", "source_entity_id", "adapter_name")


def timed(f: DataFrame, adapters: DataFrame) -> DataFrame:
    """``f`` with valid_from and valid_to in the two standard forms, whatever their notation; null (open) where a value
    is missing, names no time or has two readings. ``adapters``: adapter_name, tz, date_order."""
    f = f.join(adapters, "adapter_name", "left")
    ends = ["valid_from", "valid_to"]
    f = normalised_all(f, ends, "tz", "date_order").withColumns({c: K.utc_or_null(F.col(f"{c}_norm")) for c in ends})
    return f.drop("adapter_name", "tz", "date_order", *(f"{c}_{k}" for c in ends for k in ("norm", "us", "is_date")))


def graph(spark: SparkSession, d: str, where: Column | str = "true") -> DataFrame:
    """Facts spelled evenly with periods in the standard forms. ``where`` may use all but the period; it is applied
    before the times are read."""
    return timed(spelled(spark, d).where(where), adapters(spark, d))


_E = "replace(replace(lower({0}), ' ', '_'), '\'\'', '')"
_N = "CASE WHEN {0}.norm NOT IN ('none', 'ambiguous') THEN replace({0}.norm, '.000000Z', 'Z') END"
_G = f"""{WITH}, {ADAPTERS}, {readings(FACT_VALUES)},
    g AS (SELECT id, {_E.format('subject')} AS subject, replace(lower(predicate), ' ', '_') AS predicate, {_E.format('object')} AS object, {_N.format('b')} AS valid_from, {_N.format('e')} AS valid_to, confidence, source_entity_id
    FROM fcts LEFT JOIN ad USING (adapter_name) LEFT JOIN rd b ON {MATCH.format(r='b', v='fcts.valid_from', a='ad')} LEFT JOIN rd e ON {MATCH.format(r='e', v='fcts.valid_to', a='ad')})"""
_S, _Z = ("CASE length({0}) WHEN 10 THEN {0} || 'T" + x + ".000000Z' WHEN 20 THEN substr({0}, 1, 19) || '.000000Z' ELSE {0} END" for x in ("00:00:00", "23:59:59"))
_ASOF = f"(valid_from IS NULL OR {_S.format('valid_from')} <= '{T}T23:59:59.999999Z') AND (valid_to IS NULL OR {_Z.format('valid_to')} >= '{T}T00:00:00.000000Z')"


@query(f"{_G} SELECT id, subject, predicate, object FROM g WHERE {_ASOF}")
def kg_as_of(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).where(K.as_of(T)).select("id", "subject", "predicate", "object")


@query(f"{_G} SELECT id, predicate, direction, current FROM (SELECT *, 'outgoing' AS direction FROM g WHERE subject = '{HUB}' UNION ALL SELECT *, 'incoming' FROM g WHERE object = '{HUB}'), LATERAL (SELECT valid_to IS NULL AS current)")
def kg_entity_both(spark: SparkSession, d: str) -> DataFrame:
    return K.about(graph(spark, d, (F.col("subject") == HUB) | (F.col("object") == HUB)), HUB).select("id", "predicate", "direction", "current")


@query(f"{_G} SELECT id, subject, object, valid_from FROM g WHERE predicate = 'owned_by' AND {_ASOF}")
def kg_relationship(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, F.col("predicate") == "owned_by").where(K.as_of(T)).select("id", "subject", "object", "valid_from")


@query(f"{_G} SELECT id, predicate, object, valid_from FROM g WHERE subject = '{HUB}' ORDER BY {_S.format('valid_from')} NULLS LAST, id LIMIT 100")
def kg_timeline(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, F.col("subject") == HUB).orderBy(K.start_key(F.col("valid_from")).asc_nulls_last(), "id").limit(100).select("id", "predicate", "object", "valid_from")


@query(f"{_G} SELECT count(*) AS total, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicate_list, count(*) FILTER (valid_to IS NULL) AS current, count(valid_to) AS expired FROM g")
def kg_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicate_list"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count("valid_to").alias("expired"))


@query(
    f"""{_G}, s AS (SELECT DISTINCT * FROM (SELECT subject AS a, predicate AS via, object AS b, 0 AS back FROM g UNION ALL SELECT object, predicate || ' (inverse)', subject, 1 FROM g) WHERE a IS NOT NULL AND b IS NOT NULL),
    h1 AS (SELECT b AS entity, 1 AS hop, arg_min(via, (back, a, via)) AS via, arg_min(a, (back, a, via)) AS source FROM s WHERE a = '{HUB}' AND b <> '{HUB}' GROUP BY b),
    h2 AS (SELECT b AS entity, 2 AS hop, arg_min(via, (back, a, via)) AS via, arg_min(a, (back, a, via)) AS source FROM s WHERE a IN (SELECT entity FROM h1) AND b <> '{HUB}' AND b NOT IN (SELECT entity FROM h1) GROUP BY b)
    SELECT * FROM h1 UNION ALL SELECT * FROM h2"""
)
def kg_related_2hop(spark: SparkSession, d: str) -> DataFrame:
    return K.walk(spelled(spark, d), HUB, 2)


@query(f"{_G} SELECT name, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, split_part(min(k), '|', 2) AS first_seen, split_part(max(k), '|', 2) AS last_seen FROM (SELECT subject AS name, 1 AS o, 0 AS i, {_S.format('valid_from')} || '|' || valid_from AS k FROM g UNION ALL SELECT object, 0, 1, {_S.format('valid_from')} || '|' || valid_from FROM g) WHERE name IS NOT NULL GROUP BY name")
def kg_entity_card(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    side = lambda c, o, i: g.select(F.col(c).alias("name"), F.lit(o).alias("o"), F.lit(i).alias("i"), "valid_from")
    both = side("subject", 1, 0).unionByName(side("object", 0, 1)).where("name IS NOT NULL")
    seen = F.when(F.col("valid_from").isNotNull(), F.struct(K.start_key(F.col("valid_from")), "valid_from"))
    return both.groupBy("name").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.min(seen)["valid_from"].alias("first_seen"), F.max(seen)["valid_from"].alias("last_seen"))


@query(f"{_G} SELECT DISTINCT s AS subject, predicate, o AS object, valid_from, valid_to FROM (SELECT *, CASE WHEN subject = 'low' THEN 'high' ELSE subject END AS s, CASE WHEN object = 'low' THEN 'high' ELSE object END AS o FROM g) WHERE NOT coalesce(s = 'high' AND o = 'high', false)")
def kg_merge(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return K.merged(g, "low", "high")


@query(
    f"""WITH RECURSIVE one AS (SELECT alias, min(canonical) AS canonical FROM (SELECT {_E.format('subject')} AS alias, {_E.format('object')} AS canonical FROM facts WHERE replace(lower(predicate), ' ', '_') = 'related_to') WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1 HAVING alias <> min(canonical)),
    c AS (SELECT alias, canonical, 1 AS steps FROM one UNION ALL SELECT c.alias, one.canonical, steps + 1 FROM c JOIN one ON one.alias = c.canonical WHERE steps < 10)
    SELECT alias, arg_max(canonical, steps) AS canonical, max(steps) AS steps FROM c GROUP BY alias"""
)
def kg_resolve_chain(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").where(F.replace(F.lower("predicate"), F.lit(" "), F.lit("_")) == "related_to")
    pairs = f.select(even("subject").alias("alias"), even("object").alias("canonical")).where("alias IS NOT NULL AND canonical IS NOT NULL")
    return K.resolved(pairs, 10)


_NEW = "nw AS (SELECT subject, predicate, object, f AS valid_from, t AS valid_to, confidence FROM (SELECT subject, predicate, object, coalesce(valid_from, '') AS f0, coalesce(valid_to, '') AS t0, valid_from AS f, valid_to AS t, confidence, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY {s} DESC NULLS LAST, {z} DESC NULLS LAST, coalesce(valid_from, '') DESC, coalesce(valid_to, '') DESC, confidence DESC) AS k FROM g WHERE id % 2 = 1 AND confidence >= 0.9 AND NOT coalesce({z} < {s}, false)) WHERE k = 1)".format(z=_Z.format("valid_to"), s=_S.format("valid_from"))


@query(
    f"""{_G}, o AS (SELECT * FROM g WHERE confidence < 0.9 AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL), {_NEW.replace('id % 2 = 1 AND ', 'subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND ')}
    SELECT subject, predicate, object, coalesce(nw.valid_from, o.valid_from) AS valid_from, coalesce(nw.valid_to, o.valid_to) AS valid_to, coalesce(nw.confidence, o.confidence) AS confidence, CASE WHEN o.id IS NULL THEN 'added' WHEN nw.confidence IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
    FROM (SELECT * FROM o WHERE valid_to IS NULL) o FULL JOIN nw USING (subject, predicate, object) UNION ALL SELECT subject, predicate, object, valid_from, valid_to, confidence, 'kept' FROM o WHERE valid_to IS NOT NULL"""
)
def kg_upsert_triples(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, "subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").drop("source_entity_id")
    return K.upsert_triples(g.where("confidence < 0.9"), g.where("confidence >= 0.9").drop("id"))


@query(f"{_G} SELECT id, CASE WHEN valid_to IS NULL AND coalesce(predicate = 'has_status' AND object = 'paused', false) AND (valid_from IS NULL OR {_S.format('valid_from')} <= '{T}T23:59:59.999999Z') THEN '{T}' ELSE valid_to END AS valid_to FROM g")
def kg_invalidate(spark: SparkSession, d: str) -> DataFrame:
    gone = F.coalesce((F.col("predicate") == "has_status") & (F.col("object") == "paused"), F.lit(False))
    return K.invalidate(graph(spark, d), gone, T).select("id", "valid_to")


_W = "[\\p{L}\\p{N}_-]"
_CLAIM = [rf"([A-Z]{_W}+)\s+is\s+([A-Z]{_W}+)''s\s+([a-z]{{3,20}})\b", rf"([A-Z]{_W}+)''s\s+([a-z]{{3,20}})\s+is\s+([A-Z]{_W}+)", r"([\p{L}]+) (replaced|contradicts|follows|covers) the ([a-z]+ [a-z]+)"]
_CLAIMS = " UNION ".join(f"SELECT id, {_E.format(f'x.g{s}')} AS subject, lower(x.g{c}) AS claimed, {_E.format(f'x.g{o}')} AS object FROM (SELECT id, regexp_extract(unnest(regexp_extract_all(content, '{p}')), '{p}', ['g1', 'g2', 'g3']) AS x FROM ents)" for p, (s, c, o) in zip(_CLAIM, ((1, 3, 2), (3, 2, 1), (1, 2, 3)), strict=True))


@query(
    f"""{_G}, c AS ({_CLAIMS}), h AS (SELECT subject, object, predicate AS held, bool_or(NOT over) AS current, split_part(max(CASE WHEN over THEN {_Z.format('valid_to')} || '|' || valid_to END), '|', 2) AS ended FROM (SELECT *, coalesce({_Z.format('valid_to')} < '{T}T00:00:00.000000Z', false) AS over FROM g WHERE predicate IS NOT NULL) GROUP BY ALL)
    SELECT * FROM (SELECT id, subject, object, claimed, held, CASE WHEN held = claimed THEN ended END AS valid_to, CASE WHEN held = claimed AND ended IS NOT NULL THEN 'stale_fact' WHEN held <> claimed AND current THEN 'relationship_mismatch' END AS problem FROM c JOIN h USING (subject, object)) WHERE problem IS NOT NULL"""
)
def claim_check(spark: SparkSession, d: str) -> DataFrame:
    c = written(K.claims_of(entities(spark, d).select("id", "content")).withColumns({k: even(k) for k in ("subject", "object")}).distinct())
    f = spelled(spark, d).join(c.select("subject", "object").distinct(), ["subject", "object"], "left_semi")
    return K.contradicted(c, timed(f, adapters(spark, d)), T)


@query(f"""{_G} SELECT DISTINCT lower(m[1]) AS a, lower(m[2]) AS b FROM (SELECT unnest(regexp_extract_all(content, '[\\p{{L}}]+ (?:replaced|contradicts|follows|covers) the [a-z]+ [a-z]+')) AS s FROM ents), LATERAL (SELECT regexp_extract(s, '([\\p{{L}}]+) (replaced|contradicts|follows|covers) the ([a-z]+ [a-z]+)', ['a0', 'r0', 'b0']) AS x), LATERAL (SELECT [x.a0, x.b0] AS m)""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    # Claims of the form "A <verb> the B" in the texts; verbs stand for the roles of the relation.
    s = table(spark, d, "entities").select(F.explode(F.regexp_extract_all("content", F.lit(r"[\p{L}]+ (?:replaced|contradicts|follows|covers) the [a-z]+ [a-z]+"), F.lit(0))).alias("s"))
    pat = r"([\p{L}]+) (replaced|contradicts|follows|covers) the ([a-z]+ [a-z]+)"
    return s.select(F.lower(F.regexp_extract("s", pat, 1)).alias("a"), F.lower(F.regexp_extract("s", pat, 3)).alias("b")).distinct()


@query(f"{_G}, n AS (SELECT subject AS name FROM g WHERE subject IS NOT NULL UNION SELECT object FROM g WHERE object IS NOT NULL) SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 WHERE levenshtein(a.name, b.name) BETWEEN 1 AND 2")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    f = spelled(spark, d)
    return K.near_names(f.select(F.col("subject").alias("name")).unionByName(f.select(F.col("object").alias("name"))))


@query(f"{_G} SELECT subject, predicate, count(*) AS versions, split_part(max({_S.format('valid_from')} || '|' || valid_from), '|', 2) AS latest_from, arg_max(object, coalesce({_S.format('valid_from')}, '') || lpad(id::VARCHAR, 20, '0')) AS latest_object FROM g WHERE predicate IN (SELECT predicate FROM predicates WHERE single_valued) GROUP BY ALL")
def kg_latest(spark: SparkSession, d: str) -> DataFrame:
    single = table(spark, d, "predicates").where("single_valued").select("predicate")
    key = K.start_key(F.col("valid_from"))
    known = F.when(F.col("valid_from").isNotNull(), F.struct(key, "valid_from"))
    g = timed(spelled(spark, d).join(single, "predicate", "left_semi"), adapters(spark, d))
    return g.groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("versions"), F.max(known)["valid_from"].alias("latest_from"), F.max_by("object", F.struct(key, "id")).alias("latest_object"))
