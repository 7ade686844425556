"""Queries of the navigation graph and the dynamics of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import graph as G
from memloom.operators.timestamps import adapters, created
from memloom.plans.base import registry
from memloom.plans.times_sql import TIMED
from memloom.session import table
from memloom.sources.tables import WITH, entities, meta, meta_sql, nodes

QUERIES, SQL, query = registry()


def gated(spark: SparkSession, d: str, dates: bool = False) -> DataFrame:
    """Entities with their adapter as gate and, with ``dates``, the UTC day of creation where it is known (else null)."""
    e, day = entities(spark, d), F.lit(None).cast("string")
    if dates:
        e, day = created(e, adapters(spark, d), "id", "realm", "domain", "source_file", "metadata"), F.when(F.col("us").isNotNull(), F.substring("norm", 1, 10))
    return e.select("id", "realm", "domain", "source_file", meta("added_by").alias("gate"), meta("topic").alias("topic"), day.alias("date"))


def graph_of(spark: SparkSession, d: str, dates: bool = False) -> DataFrame:
    return G.domain_nodes(gated(spark, d, dates))


_DAY = "CASE WHEN regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(created_at, 1, 10) END"
_GATED = f"{WITH}, gated AS (SELECT id, realm, domain, source_file, {meta_sql('added_by')} AS gate, {meta_sql('topic')} AS topic, {_DAY} AS date FROM ents)"
_NODES = f"{_GATED}, n AS (SELECT domain, list_sort(list_distinct(list(realm))) AS realms, list_sort(list_distinct(list(gate) FILTER (gate IS NOT NULL))) AS gates, count(*) AS n, list_sort(list_distinct(list(date) FILTER (date IS NOT NULL)))[-5:] AS dates FROM gated WHERE domain <> 'general' AND trim(realm) <> '' GROUP BY domain)"
_EDGES = f"{_NODES}, e AS (SELECT domain, a AS realm_a, b AS realm_b, gate, n FROM n, unnest(realms) t(a), unnest(realms) u(b), unnest(gates) v(gate) WHERE a < b)"


@query(f"{_NODES.replace('FROM ents', 'FROM tents').replace(WITH, TIMED).replace(_DAY, "CASE WHEN us IS NOT NULL THEN substr(norm, 1, 10) END")} SELECT domain, array_to_string(realms, ',') AS realms, array_to_string(gates, ',') AS gates, n, array_to_string(dates, ',') AS dates FROM n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d, dates=True).select("domain", *(F.array_join(c, ",").alias(c) for c in ("realms", "gates")), "n", F.array_join("dates", ",").alias("dates"))


@query(f"{_EDGES} SELECT * FROM e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.domain_edges(graph_of(spark, d))


@query(f"{_EDGES} SELECT (SELECT count(*) FROM n) AS domains, (SELECT count(*) FROM n WHERE len(realms) >= 2) AS tunnel_domains, (SELECT count(*) FROM e) AS edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d)
    r, k = F.size("realms"), F.size("gates")
    return g.agg(F.count(F.lit(1)).alias("domains"), F.count_if(r >= 2).alias("tunnel_domains"), F.sum((r * (r - 1) / 2 * k).cast("long")).alias("edges"))


@query(f"{_NODES} SELECT realm, count(*) AS domains FROM n, unnest(realms) t(realm) GROUP BY realm")
def domains_per_realm(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).select(F.explode("realms").alias("realm")).groupBy("realm").agg(F.count(F.lit(1)).alias("domains"))


@query(f"{_NODES} SELECT domain, array_to_string(realms, ',') AS realms, n FROM n WHERE len(realms) >= 2 AND list_contains(realms, 'work') AND list_contains(realms, 'home') ORDER BY n DESC, domain LIMIT 50")
def find_tunnels(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d).where((F.size("realms") >= 2) & F.array_contains("realms", "work") & F.array_contains("realms", "home"))
    return g.select("domain", F.array_join("realms", ",").alias("realms"), "n").orderBy(F.desc("n"), "domain").limit(50)


@query(
    f"""{_NODES}, s AS (SELECT domain, n, realm FROM n, unnest(realms) t(realm)), x1 AS (SELECT b.domain, min(a.domain) AS pre FROM s a JOIN s b USING (realm) WHERE a.domain = 'contacts' AND b.domain <> 'contacts' GROUP BY 1),
    h1 AS (SELECT x1.domain, 1 AS hop, any_value(b.n) AS n, string_agg(realm, ',' ORDER BY realm) AS via FROM x1 JOIN s b USING (domain) JOIN s a USING (realm) WHERE a.domain = pre GROUP BY 1),
    x2 AS (SELECT b.domain, min(a.domain) AS pre FROM s a JOIN s b USING (realm) WHERE a.domain IN (SELECT domain FROM h1) AND b.domain <> 'contacts' AND b.domain NOT IN (SELECT domain FROM h1) GROUP BY 1),
    h2 AS (SELECT x2.domain, 2 AS hop, any_value(b.n) AS n, string_agg(realm, ',' ORDER BY realm) AS via FROM x2 JOIN s b USING (domain) JOIN s a USING (realm) WHERE a.domain = pre GROUP BY 1)
    SELECT * FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY hop, n DESC, domain LIMIT 50"""
)
def traverse_2hop(spark: SparkSession, d: str) -> DataFrame:
    return G.traverse(graph_of(spark, d), "contacts", 2)


@query(f"{_NODES} SELECT domain, CASE WHEN contains(domain, 'read') THEN 1::DOUBLE WHEN contains(domain, 'plan') THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score FROM (SELECT domain FROM n) WHERE contains(domain, 'plan') OR contains(domain, 'notes') ORDER BY 2 DESC, domain LIMIT 5".replace("WHEN contains(domain, 'read') THEN 1::DOUBLE WHEN contains(domain, 'plan') THEN 0.5::DOUBLE ELSE 0::DOUBLE END", "WHEN contains(domain, 'plan-notes') OR contains('plan-notes', domain) THEN 1::DOUBLE ELSE 0.5::DOUBLE END"))
def fuzzy_domains(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d).select("domain", G.likeness(F.col("domain"), "plan-notes").alias("score"))
    return g.where("score > 0").orderBy(F.desc("score"), "domain").limit(5)


_PAIRS = f"{_GATED}, t AS (SELECT DISTINCT realm, lower(trim(topic)) AS topic FROM gated WHERE trim(topic) <> ''), p AS (SELECT a.realm AS realm_a, b.realm AS realm_b, topic FROM t a JOIN t b USING (topic) WHERE a.realm < b.realm)"


@query(f"{_PAIRS} SELECT realm_a, realm_b, count(*) AS shared, string_agg(topic, ',' ORDER BY topic) AS topics FROM p GROUP BY ALL HAVING count(*) >= 2")
def topic_tunnels(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_topics(gated(spark, d).where("topic IS NOT NULL"), 2)


@query(f"{_PAIRS} SELECT DISTINCT substr(sha256(array_to_string(list_sort([realm_a || '/' || topic, realm_b || '/' || topic]), '↔')), 1, 16) AS id, realm_a, realm_b, topic AS label, 'topic' AS kind FROM p")
def tunnels(spark: SparkSession, d: str) -> DataFrame:
    t = G.shared_topics(gated(spark, d).where("topic IS NOT NULL"), 1).select("realm_a", "realm_b", F.explode(F.split("topics", ",")).alias("label"))
    end = lambda c: F.concat(F.col(c), F.lit("/"), F.col("label"))
    return t.select(G.link_id(end("realm_b"), end("realm_a")).alias("id"), "realm_a", "realm_b", "label", F.lit("topic").alias("kind"))


@query(
    f"""{_PAIRS}, l AS (SELECT topic, CASE WHEN realm_a = 'work' THEN realm_b ELSE realm_a END AS target, CASE WHEN realm_a = 'work' THEN 'outgoing' ELSE 'incoming' END AS direction FROM p WHERE realm_a = 'work' OR realm_b = 'work'),
    first AS (SELECT g.realm, lower(trim(g.topic)) AS topic, min(g.id) AS id FROM gated g WHERE trim(g.topic) <> '' GROUP BY 1, 2) SELECT l.topic AS label, target, direction, first.id AS entity_id, substr(content, 1, 300) AS preview FROM l LEFT JOIN first ON first.realm = target AND first.topic = l.topic LEFT JOIN ents ON ents.id = first.id"""
)
def follow_tunnels(spark: SparkSession, d: str) -> DataFrame:
    g = gated(spark, d).where("topic IS NOT NULL")
    t = G.shared_topics(g, 1).where("realm_a = 'work' OR realm_b = 'work'").select("realm_a", "realm_b", F.explode(F.split("topics", ",")).alias("label"))
    out = F.col("realm_a") == "work"
    t = t.select("label", F.when(out, F.col("realm_b")).otherwise(F.col("realm_a")).alias("target"), F.when(out, "outgoing").otherwise("incoming").alias("direction"))
    first = g.groupBy(F.col("realm").alias("target"), F.lower(F.trim("topic")).alias("label")).agg(F.min("id").alias("entity_id"))
    text = entities(spark, d).select(F.col("id").alias("entity_id"), F.substring("content", 1, 300).alias("preview"))
    return t.join(first, ["target", "label"], "left").join(text, "entity_id", "left").select("label", "target", "direction", "entity_id", "preview")


_NAMES = f"{WITH}, r AS (SELECT id, realm, domain, list_sort(list_distinct(string_split(regexp_extract(line, '¦([^¦]*)¦', 1), ';'))) AS names FROM nods, unnest(string_split(content, chr(10))) u(line) WHERE regexp_matches(line, '¦[^¦]+¦'))"
_GATE = f"{_NAMES}, p AS (SELECT realm, domain, a, b FROM r, unnest(names) t(a), unnest(names) u(b) WHERE a < b AND a <> ''), gw AS (SELECT realm, a, b, count(*) AS n, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM p GROUP BY realm, a, b)"


def named_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the nodes with the names they tie together."""
    lines = nodes(spark, d).select("id", "realm", "domain", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike("¦[^¦]+¦"))
    return lines.select("id", "realm", "domain", F.array_remove(F.split(F.regexp_extract("line", "¦([^¦]*)¦", 1), ";"), "").alias("names"))


@query(f"{_GATE} SELECT * FROM gw WHERE n >= 2")
def gateways(spark: SparkSession, d: str) -> DataFrame:
    return G.co_occurrence(named_lines(spark, d), 2)


@query(f"{_NAMES}, x AS (SELECT DISTINCT realm, name FROM r, unnest(names) t(name) WHERE name <> '') SELECT a.realm AS realm_a, b.realm AS realm_b, count(*) AS shared FROM x a JOIN x b USING (name) WHERE a.realm < b.realm GROUP BY ALL")
def entity_tunnels(spark: SparkSession, d: str) -> DataFrame:
    n = named_lines(spark, d).select("realm", F.explode("names").alias("topic"))
    by = n.distinct().groupBy("topic").agg(F.array_sort(F.collect_set("realm")).alias("rs"))
    pairs = F.flatten(F.transform("rs", lambda a: F.transform(F.filter("rs", lambda b: a < b), lambda b: F.struct(a.alias("realm_a"), b.alias("realm_b")))))
    return by.select(F.explode(pairs).alias("p")).groupBy("p.realm_a", "p.realm_b").agg(F.count(F.lit(1)).alias("shared"))


_DAYS = "(epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 86400::DOUBLE"


@query(f"SELECT user_id, round(CASE WHEN {_DAYS} > 0 THEN greatest(0.05::DOUBLE, (1 + avg(value) / 100) * exp(-({_DAYS}) / CASE WHEN count(*) > 0 THEN count(*)::DOUBLE ELSE 1 END)) ELSE 1 + avg(value) / 100 END, 6) AS strength FROM events GROUP BY user_id")
def decay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    days = (F.unix_micros(F.lit("2024-02-01").cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(86400e6)
    return e.select("user_id", F.round(G.decayed(1 + F.col("v") / 100, F.col("n"), days), 6).alias("strength"))


@query("SELECT user_id, round(least(5::DOUBLE, 1 + 0.05::DOUBLE * count(*)), 6) AS strength, round(1 + 0.1::DOUBLE * sum(rested), 6) AS stability, count(*) AS activations FROM (SELECT user_id, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 3600000000) >= 3600000000 THEN 1 ELSE 0 END AS rested FROM events) GROUP BY user_id")
def potentiation(spark: SparkSession, d: str) -> DataFrame:
    return G.potentiated(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")


@query(
    f"""WITH RECURSIVE {WITH[5:]}, r AS (SELECT DISTINCT id, id2 FROM nods, unnest(regexp_extract_all(content, 'ent_[0-9]+')) t(id2)), e AS (SELECT id AS a, id2 AS b FROM r UNION SELECT id2, id FROM r),
    reach AS (SELECT a AS node, a AS component FROM e UNION SELECT e.b, reach.component FROM reach JOIN e ON e.a = reach.node WHERE reach.component < e.b) SELECT node, min(component) AS component FROM reach GROUP BY node"""
)
def linked_components(spark: SparkSession, d: str) -> DataFrame:
    e = nodes(spark, d).select(F.col("id").alias("a"), F.explode(F.regexp_extract_all("content", F.lit("ent_[0-9]+"), F.lit(0))).alias("b")).distinct()
    return G.components(e)
