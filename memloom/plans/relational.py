"""Queries over realms, domains, entities and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import relational as R
from memloom.operators.timestamps import adapters, created
from memloom.plans.base import registry
from memloom.plans.times_sql import TIMED
from memloom.session import table
from memloom.sources.tables import WITH, entities, meta, meta_sql, nodes

QUERIES, SQL, query = registry()


@query("SELECT id, realm, domain, content FROM entities WHERE id = 'ent_000000042' GROUP BY ALL")
def get_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("id = 'ent_000000042'").select("id", "realm", "domain", "content").distinct()


@query(f"{TIMED} SELECT id, realm, domain, created_at FROM tents WHERE realm = 'work' ORDER BY us DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def list_entities_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(created(entities(spark, d, "realm = 'work'"), adapters(spark, d), "id", "realm", "domain", "created_at"), 20, 20).select("id", "realm", "domain", "created_at")


@query(f"{WITH} SELECT r.name, r.description, count(e.id) AS entities FROM realms r LEFT JOIN ents e ON e.realm = r.name GROUP BY ALL")
def realm_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").select("id", "realm").distinct().groupBy("realm").agg(F.count("id").alias("n"))
    r = table(spark, d, "realms")
    return r.join(n, r["name"] == n["realm"], "left").select("name", "description", F.coalesce("n", F.lit(0)).alias("entities"))


@query(f"{WITH} SELECT m.name, m.realm, count(e.id) AS entities FROM domains m LEFT JOIN ents e ON e.realm = m.realm AND e.domain = m.name GROUP BY ALL")
def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").select("id", "realm", F.col("domain").alias("name")).distinct().groupBy("realm", "name").agg(F.count("id").alias("n"))
    return table(spark, d, "domains").join(n, ["realm", "name"], "left").select("name", "realm", F.coalesce("n", F.lit(0)).alias("entities"))


@query(f"{WITH} SELECT realm, domain, count(*) AS entities FROM ents GROUP BY ROLLUP (realm, domain)")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("id", "realm", "domain").distinct().rollup("realm", "domain").agg(F.count(F.lit(1)).alias("entities"))


@query(f"{WITH} SELECT (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM nods) AS nodes, (SELECT count(*) FROM realms) AS realms, (SELECT count(*) FROM domains) AS domains, (SELECT count(DISTINCT id) FROM docs) AS vectors")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, c: table(spark, d, name).agg(F.count_distinct(*c))
    parts = [one("entities", ["id"]), one("nodes", ["id"]), one("realms", ["name"]), one("domains", ["name", "realm"]), one("docs", ["id"])]
    out = None
    for name, p in zip(("entities", "nodes", "realms", "domains", "vectors"), parts, strict=True):
        p = p.toDF(name)
        out = p if out is None else out.join(F.broadcast(p))  # single rows
    return out


@query(f"{TIMED} SELECT (SELECT count(*) FROM tents) AS total, id AS latest_id, substr(content, 1, 100) AS preview FROM tents ORDER BY us DESC NULLS LAST, id DESC LIMIT 1")
def memories_filed_away(spark: SparkSession, d: str) -> DataFrame:
    e = created(entities(spark, d), adapters(spark, d), "id", "content")
    at = F.struct("us", "id")  # unknown times are the least
    return e.agg(F.count(F.lit(1)).alias("total"), F.max_by("id", at).alias("latest_id"), F.substring(F.max_by("content", at), 1, 100).alias("preview"))


_TREE = {"$or": [{"importance": "high"}, {"$and": [{"topic": {"$in": ["window", "glossary", "digest"]}}, {"chunk_index": {"$gte": 3, "$lt": 40}}]}], "added_by": {"$ne": "sweeper"}}
_CI = f"TRY_CAST({meta_sql('chunk_index')} AS DOUBLE)"
_TREE_SQL = f"(coalesce({meta_sql('importance')} = 'high', false) OR (coalesce({meta_sql('topic')} IN ('window', 'glossary', 'digest'), false) AND coalesce({_CI} >= 3 AND {_CI} < 40, false)))"


@query(f"{WITH} SELECT id FROM ents WHERE {_TREE_SQL} AND coalesce({meta_sql('added_by')} <> 'sweeper', true)")
def metadata_where(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where(R.where(_TREE)).select("id")


@query(f"{WITH} SELECT id FROM ents WHERE {_TREE_SQL} AND {meta_sql('added_by')} <> 'sweeper'")
def metadata_where_sql_nulls(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where(R.where(_TREE, "sql")).select("id")


@query(f"{WITH} SELECT id, domain FROM ents WHERE content ILIKE '%glossary of%'")
def doc_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where(R.contains(F.col("content"), "glossary of")).select("id", "domain").distinct()


@query(f"SELECT DISTINCT id, text FROM docs WHERE {meta_sql('realm')} = 'work' AND text ILIKE '%ledger%' ORDER BY id LIMIT 25 OFFSET 5")
def vector_rows_where(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "docs").where(R.where({"realm": "work"}) & R.contains(F.col("text"), "ledger"))
    return r.select("id", "text").distinct().orderBy("id").offset(5).limit(25)


@query(f"{WITH} SELECT id, realm, domain, content, source_file FROM ents WHERE realm = 'research' AND domain = 'daily'")
def export_filtered(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, "realm = 'research' AND domain = 'daily'").select("id", "realm", "domain", "content", "source_file")


@query(f"{WITH} SELECT realm, domain, '# ' || realm || ' / ' || domain || chr(10) || chr(10) || string_agg('- ' || coalesce(source_file, 'unknown') || ' (' || n || ')', chr(10) ORDER BY coalesce(source_file, 'unknown')) AS markdown FROM (SELECT realm, domain, source_file, count(*) AS n FROM ents GROUP BY ALL) GROUP BY realm, domain")
def markdown_index(spark: SparkSession, d: str) -> DataFrame:
    per = entities(spark, d).groupBy("realm", "domain", "source_file").agg(F.count(F.lit(1)).alias("n"))
    name = F.coalesce("source_file", F.lit("unknown"))
    line = F.struct(name.alias("k"), F.concat(F.lit("- "), name, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("v"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["v"]), "\n")
    return per.groupBy("realm", "domain").agg(F.concat(F.lit("# "), F.col("realm"), F.lit(" / "), F.col("domain"), F.lit("\n\n"), lines).alias("markdown"))


@query(f"{WITH} SELECT DISTINCT source_file FROM ents WHERE source_file <> '' AND {meta_sql('added_by')} IN ('convo_miner', 'file_miner', 'format_miner')")
def mined_sources(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where((F.col("source_file") != "") & meta("added_by").isin("convo_miner", "file_miner", "format_miner")).select("source_file").distinct()


@query(f"{WITH} SELECT DISTINCT source_file FROM documents WHERE source_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.source_file = documents.source_file)")
def sources_not_mined(spark: SparkSession, d: str) -> DataFrame:
    return R.delete(table(spark, d, "documents").where("source_file IS NOT NULL").select("source_file").distinct(), table(spark, d, "entities").where("source_file IS NOT NULL"), "source_file")


@query(f"{WITH} SELECT id FROM ents WHERE coalesce({meta_sql('importance')} = 'high', false) OR {meta_sql('importance')} IS NULL")
def extract_mode_rows(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where((meta("importance") == "high") | meta("importance").isNull()).select("id")


@query(f"{WITH} SELECT id, source_file FROM ents WHERE coalesce(source_file, '') NOT GLOB '*.bak*' AND coalesce(source_file, '') NOT GLOB 'inbox/*.py'")
def glob_excluded(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where(~R.globbed(F.coalesce("source_file", F.lit("")), ["*.bak*", "inbox/*.py"])).select("id", "source_file")


@query("SELECT DISTINCT subject AS name FROM facts WHERE regexp_full_match(trim(subject), '[\\p{L}\\p{N}]([\\p{L}\\p{N}_ .''-]{0,126}[\\p{L}\\p{N}])?') AND NOT contains(subject, '..')")
def valid_subject_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").where(R.valid_name(F.col("subject"))).select(F.col("subject").alias("name")).distinct()


@query(f"{WITH} SELECT CASE WHEN coalesce(source_file, '') = '' THEN 'unknown' ELSE source_file END AS source, count(*) AS n FROM ents GROUP BY 1 HAVING count(*) >= 5")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.coalesce("source_file", F.lit("")) == "", "unknown").otherwise(F.col("source_file"))
    return table(spark, d, "entities").select("id", "source_file").distinct().groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"{WITH} SELECT count(*) AS sources, sum(n)::BIGINT AS entities, sum(floor(n * 0.4::DOUBLE))::BIGINT AS expected_duplicates FROM (SELECT source_file, count(*) AS n FROM ents WHERE source_file <> '' GROUP BY 1 HAVING count(*) > 20)")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").where("source_file <> ''").select("id", "source_file").distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).where("n > 20")
    return n.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("entities"), F.sum(F.floor(F.col("n") * F.lit(0.4))).alias("expected_duplicates"))


@query("SELECT DISTINCT subject AS name FROM facts WHERE lower(subject) NOT IN ('user', 'assistant', 'project', 'shared memory hub')")
def known_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").where(~F.lower("subject").isin("user", "assistant", "project", "shared memory hub")).select(F.col("subject").alias("name")).distinct()


@query(f"{WITH} SELECT id, realm, domain, content FROM ents WHERE id NOT IN (SELECT id FROM nods) AND id NOT IN (SELECT id FROM docs WHERE trim(text) <> '') UNION ALL SELECT id, max({meta_sql('realm')}), max({meta_sql('domain')}), max(text) FROM docs WHERE trim(text) <> '' GROUP BY id")
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "docs").groupBy("id").agg(F.max(meta("realm")).alias("realm"), F.max(meta("domain")).alias("domain"), F.max("text").alias("content")).withColumn("seq", F.lit(1))
    return R.upsert(entities(spark, d).select("id", "realm", "domain", "content"), new)


@query(f"{WITH} SELECT id FROM ents WHERE id NOT IN (SELECT id FROM docs WHERE vector IS NULL)")
def delete_entities(spark: SparkSession, d: str) -> DataFrame:
    return R.delete(entities(spark, d), table(spark, d, "docs").where("vector IS NULL"), "id").select("id")


@query(f"{WITH} SELECT realm, count(*) AS entities FROM ents WHERE realm <> 'archive' GROUP BY realm")
def cascade_delete_realm(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, "realm <> 'archive'").groupBy("realm").agg(F.count(F.lit(1)).alias("entities"))


@query("SELECT name FROM realms UNION SELECT DISTINCT realm FROM documents WHERE realm IS NOT NULL")
def create_absent_realms(spark: SparkSession, d: str) -> DataFrame:
    return R.add_absent(table(spark, d, "realms").select("name"), table(spark, d, "documents").where("realm IS NOT NULL").select(F.col("realm").alias("name")), "name")


@query(f"{WITH} SELECT id, 'kept' AS origin FROM ents UNION ALL SELECT 'doc_' || doc_id, 'imported' FROM documents WHERE trim(text) <> '' AND ('doc_' || doc_id) NOT IN (SELECT id FROM ents)")
def import_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "documents").where(F.trim("text") != "").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.lit("imported").alias("origin"))
    return R.add_absent(entities(spark, d).select("id", F.lit("kept").alias("origin")), new, "id")


@query(f"{WITH} SELECT id, coalesce(e.id IS NOT NULL, false) AS in_rows, coalesce(v.id IS NOT NULL, false) AS in_index FROM ents e FULL JOIN (SELECT DISTINCT id FROM docs) v USING (id) WHERE e.id IS NULL OR v.id IS NULL")
def scan_divergence(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "entities").select("id").distinct().withColumn("r", F.lit(True))
    b = table(spark, d, "docs").select("id").distinct().withColumn("i", F.lit(True))
    return a.join(b, "id", "full").where("r IS NULL OR i IS NULL").select("id", F.coalesce("r", F.lit(False)).alias("in_rows"), F.coalesce("i", F.lit(False)).alias("in_index"))


@query(f"""{WITH} SELECT bucket, count(*) AS n, count(DISTINCT source_file) AS sources FROM (SELECT source_file, CASE WHEN {meta_sql('is_sentinel')} = 'true' THEN 'kept' WHEN coalesce(source_file, '') = '' THEN 'no_source'
    WHEN NOT (source_file LIKE 'docs/%' OR source_file LIKE 'src/%' OR source_file LIKE 'notes/%') THEN 'out_of_scope' WHEN regexp_matches(source_file, '\\.(log|bak)(\\.|$)') THEN 'ignored'
    WHEN source_file NOT IN (SELECT source_file FROM nods WHERE source_file IS NOT NULL) THEN 'missing' ELSE 'kept' END AS bucket FROM ents) GROUP BY bucket""")
def sync_buckets(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "nodes").select("source_file").where("source_file IS NOT NULL").distinct().withColumn("there", F.lit(True))
    s = F.col("source_file")
    e = entities(spark, d).join(listed, "source_file", "left")
    scope = s.startswith("docs/") | s.startswith("src/") | s.startswith("notes/")
    bucket = F.when(meta("is_sentinel") == "true", "kept").when(F.coalesce(s, F.lit("")) == "", "no_source").when(~scope, "out_of_scope").when(s.rlike(r"\.(log|bak)(\.|$)"), "ignored").when(F.col("there").isNull(), "missing").otherwise("kept")
    return e.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("sources"))


@query(f"""{WITH} SELECT id, root FROM (SELECT e.id, r.root, row_number() OVER (PARTITION BY e.id ORDER BY length(r.root) DESC) AS k FROM ents e JOIN (VALUES ('docs/'), ('docs/p00/'), ('src/'), ('notes/p00/')) r(root) ON starts_with(e.source_file, r.root)) WHERE k = 1""")
def project_roots(spark: SparkSession, d: str) -> DataFrame:
    # Prefixes of a path are its own rows, so the longest root is found by an equality test.
    roots = ["docs/p00/", "notes/p00/", "docs/", "src/"]
    hit = F.coalesce(*(F.when(F.startswith("source_file", F.lit(r)), r) for r in sorted(roots, key=len, reverse=True)))
    return entities(spark, d).select("id", hit.alias("root")).where("root IS NOT NULL")


@query(f"{WITH} SELECT added_by, realm, n FROM (SELECT {meta_sql('added_by')} AS added_by, realm, count(*) AS n, row_number() OVER (PARTITION BY {meta_sql('added_by')} ORDER BY count(*) DESC, realm) AS k FROM ents WHERE {meta_sql('added_by')} IS NOT NULL GROUP BY 1, 2) WHERE k <= 3")
def agent_top_realms(spark: SparkSession, d: str) -> DataFrame:
    n = entities(spark, d).withColumn("added_by", meta("added_by")).where("added_by IS NOT NULL").groupBy("added_by", "realm").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("added_by").orderBy(F.desc("n"), "realm"))
    return n.withColumn("k", k).where("k <= 3").drop("k")


@query(f"{WITH} SELECT substr(realm, 7) AS agent, count(*) AS records FROM ents WHERE realm LIKE 'agent\\_%' ESCAPE '\\' GROUP BY 1")
def agents(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d, "startswith(realm, 'agent_')").groupBy(F.substring("realm", 7, 1000).alias("agent")).agg(F.count(F.lit(1)).alias("records"))


@query(f"{WITH} SELECT id, unnest(list_distinct(regexp_extract_all(content, 'ent_[0-9]+'))) AS ref FROM nods")
def node_references(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("ent_[0-9]+"), F.lit(0)))).alias("ref"))
