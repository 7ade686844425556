"""Queries of ingest, changes to the store, routing, and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import markers as M
from memloom.functions import text as T
from memloom.functions.words import words
from memloom.operators import kg as K
from memloom.operators import relational as R
from memloom.operators.timestamps import adapters, created
from memloom.plans.base import registry
from memloom.plans.graph import SQL as GRAPH_SQL
from memloom.plans.graph import tunnels
from memloom.plans.kg import _E, even
from memloom.plans.text import SQL as TEXT_SQL
from memloom.plans.text import _TURNS, turns
from memloom.plans.text import l1_essential
from memloom.plans.times_sql import TIMED
from memloom.session import table
from memloom.sources.tables import WITH, entities, facts, meta, meta_sql, nodes

QUERIES, SQL, query = registry()


# Changes


@query(
    f"""{WITH}, n AS (SELECT source_file, json_object('node_id', min(id), 'topic', 'indexed') AS new FROM nods WHERE source_file <> '' GROUP BY 1), u AS (SELECT e.id, json_merge_patch(coalesce(nullif(e.metadata, ''), '{{}}')::JSON, n.new::JSON) AS m FROM ents e JOIN n USING (source_file))
    SELECT id, key, json_extract_string(m, '$."' || key || '"') AS value FROM (SELECT id, m, unnest(json_keys(m)) AS key FROM u)"""
)
def update_entities(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the entities whose source has nodes, with new values put over the old ones, key by key."""
    n = nodes(spark, d).where("source_file <> ''").groupBy("source_file").agg(F.min("id").alias("node_id"))
    e = entities(spark, d).join(n, "source_file")
    return e.select("id", F.explode(R.merged_metadata(F.col("metadata"), {"node_id": F.col("node_id"), "topic": F.lit("indexed")})).alias("key", "value"))


@query(
    f"""WITH v AS (SELECT id, any_value(vector) AS v FROM docs WHERE coalesce({meta_sql('realm')}, '') <> 'archive' AND len(vector) = 384 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
    n AS (SELECT 'emb_' || vec_id AS id, embedding AS v FROM embeddings), u AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n)
    SELECT id, len(v)::INT AS dims, round(v[1]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM u"""
)
def vector_changes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors after deleting those of a realm and putting new ones in, all brought to length one."""
    from memloom.operators.search import dot, usable

    old = table(spark, d, "docs").where((F.coalesce(meta("realm"), F.lit("")) != "archive") & usable(F.col("vector"), 384)).groupBy("id").agg(F.first("vector").alias("vector"))
    new = table(spark, d, "embeddings").select(F.concat(F.lit("emb_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"))
    v = R.delete(old, new, "id").unionByName(new)
    first = F.get("vector", F.lit(0)).cast("double") / F.sqrt(dot(F.col("vector"), F.col("vector")))
    return v.select("id", F.size("vector").alias("dims"), F.round(first, 5).alias("first"))


_CHUNKS = "c AS (SELECT doc_id, source_file, i, substr(text, i * 800 + 1, 800) AS chunk FROM documents, unnest(range(0, (length(text) - 1) // 800 + 1)) t(i) WHERE source_file <> '' AND length(trim(text, ' ')) > {least})"


def chunks(spark: SparkSession, d: str, least: int = 30) -> DataFrame:
    """Pieces of the documents that have a source: doc_id, source_file, i, chunk."""
    return table(spark, d, "documents").where("source_file <> ''").select("doc_id", "source_file", F.posexplode(T.fixed_chunks(F.col("text"), 800, least)).alias("i", "chunk"))


@query(
    f"""{WITH}, {_CHUNKS.format(least=30)} SELECT source_file, id, 'kept' AS origin FROM ents WHERE coalesce(source_file, '') NOT IN (SELECT source_file FROM c)
    UNION ALL SELECT source_file, substr(sha256(source_file || '#' || doc_id || '#' || i), 1, 24), 'mined' FROM c"""
)
def purge_then_insert(spark: SparkSession, d: str) -> DataFrame:
    """Entities after the sources of the documents were mined again: what came from these sources is purged, their pieces are put in
    under ids that another run gives again."""
    c = chunks(spark, d)
    kept = entities(spark, d).select("source_file", "id").join(c.select("source_file").distinct(), "source_file", "left_anti")
    key = F.concat_ws("#", "source_file", F.col("doc_id").cast("string"), F.col("i").cast("string"))
    return kept.select("source_file", "id", F.lit("kept").alias("origin")).unionByName(c.select("source_file", F.substring(F.sha2(key, 256), 1, 24).alias("id"), F.lit("mined").alias("origin")))


@query(
    f"""{WITH}, {_CHUNKS.format(least=300)} SELECT '_reg_' || substr(sha256(source_file), 1, 24) AS id, source_file FROM (SELECT DISTINCT source_file FROM documents WHERE source_file <> '') WHERE source_file NOT IN (SELECT source_file FROM c)
    UNION ALL SELECT id, source_file FROM ents WHERE {meta_sql('domain')} = '_registry' OR {meta_sql('ingest_mode')} = 'registry' OR starts_with(id, '_reg_')"""
)
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only mark a source as mined: those of sources that gave no piece, and those there already."""
    empty = table(spark, d, "documents").where("source_file <> ''").select("source_file").distinct().join(chunks(spark, d, 300).select("source_file").distinct(), "source_file", "left_anti")
    new = empty.select(F.concat(F.lit("_reg_"), F.substring(F.sha2("source_file", 256), 1, 24)).alias("id"), "source_file", F.lit('{"ingest_mode": "registry"}').alias("metadata"))
    both = entities(spark, d).select("id", "source_file", "metadata").unionByName(new)
    return both.where(R.is_registry(F.col("id"))).select("id", "source_file")


@query(
    f"""WITH g AS (SELECT adapter_name, subject, predicate, object, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(created_at, '') DESC, coalesce(valid_to, '') DESC) AS k FROM facts) WHERE k = 1),
    b AS (SELECT coalesce(adapter_name, '') AS batch, count(*) AS triples, sum((coalesce(trim(subject), '') = '' OR coalesce(trim(predicate), '') = '' OR coalesce(trim(object), '') = '' OR coalesce(confidence < 0.45 OR confidence > 1, false))::INT)::BIGINT AS bad FROM g GROUP BY 1)
    SELECT batch, triples, bad, CASE WHEN bad = 0 THEN triples ELSE 0 END AS accepted FROM b"""
)
def checked_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of triples, one for each adapter: one bad row refuses its whole batch."""
    return K.checked(facts(spark, d).withColumn("batch", F.coalesce("adapter_name", F.lit(""))), "batch", 0.45)


_SPELL = "SELECT {e} AS id, {c} AS name FROM facts WHERE {c} IS NOT NULL"


@query(
    f"""WITH n AS ({_SPELL.format(e=_E.format('subject'), c='subject')} UNION ALL {_SPELL.format(e=_E.format('object'), c='object')}), c AS (SELECT id, name, count(*) AS n FROM n GROUP BY ALL)
    SELECT id, name, n::BIGINT AS mentions, aliases FROM (SELECT id, name, sum(n) OVER (PARTITION BY id) AS n, count(*) OVER (PARTITION BY id) AS aliases, row_number() OVER (PARTITION BY id ORDER BY n DESC, name) AS k FROM c) WHERE k = 1"""
)
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the graph: the id of a name evenly spelled, its most frequent spelling, how often it is named, in how many spellings."""
    f = table(spark, d, "facts")
    both = f.select(F.col("subject").alias("name")).unionByName(f.select(F.col("object").alias("name"))).where("name IS NOT NULL")
    per = both.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("id", even("name"))
    top = F.min(F.struct((-F.col("n")).alias("k"), "name"))["name"]
    return per.groupBy("id").agg(top.alias("name"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("aliases"))


@query(f"WITH t AS ({GRAPH_SQL['tunnels']}), gone AS (SELECT realm_a, min(id) AS id FROM t GROUP BY 1) SELECT id, realm_a, realm_b, label FROM t WHERE id NOT IN (SELECT id FROM gone)")
def delete_tunnels(spark: SparkSession, d: str) -> DataFrame:
    """Tunnels without the first of every realm."""
    t = tunnels(spark, d)
    return R.delete(t, t.groupBy("realm_a").agg(F.min("id").alias("id")), "id").select("id", "realm_a", "realm_b", "label")


# Mining


@query(
    """WITH c AS (SELECT doc_id, source_file, i, substr(text, i * 800 + 1, 800) AS chunk FROM documents, unnest(range(0, (length(text) - 1) // 800 + 1)) t(i) WHERE source_file <> '' AND length(trim(text, ' ')) > 30),
    k AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(chunk), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') ORDER BY doc_id, i) AS k FROM c WHERE length(trim(chunk, ' ')) >= 10)
    SELECT doc_id, i::INT AS i, length(chunk) AS chars FROM k WHERE k = 1"""
)
def mined_files(spark: SparkSession, d: str) -> DataFrame:
    """Mining as one plan: documents are cut, pieces of fewer than ten characters are left out, and of pieces with the same words the first
    stays."""
    c = chunks(spark, d).where(F.length(F.trim("chunk")) >= 10)
    key = F.trim(F.regexp_replace(F.lower("chunk"), r"[^\p{L}\p{N}]+", " "))
    # By a hash of 256 bits, so that texts aren't moved.
    first = c.groupBy(F.sha2(key, 256).alias("k")).agg(F.min(F.struct("doc_id", "i", F.length("chunk").alias("chars"))).alias("r"))
    return first.select("r.doc_id", "r.i", "r.chars")


_ROUTE = "CASE WHEN " + " WHEN ".join(f"g > 0 AND {k} = g THEN '{k}'" for k in M.TOPICS) + " ELSE 'general' END"
_TOPIC_HITS = ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) + f") AS {k}" for k, ws in M.TOPICS.items())


@query(
    f"""WITH {_TURNS}, x AS (SELECT a.doc_id, a.turn, a.message || chr(10) || coalesce(b.message, '') AS text FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.turn = a.turn + 1 AND b.role = 'Assistant' WHERE a.role = 'User'),
    h AS (SELECT *, greatest({', '.join(M.TOPICS)}) AS g FROM (SELECT *, {_TOPIC_HITS} FROM x)) SELECT doc_id, turn, {_ROUTE} AS topic, substr(sha256(doc_id || '#' || turn), 1, 24) AS id, length(text) AS chars FROM h"""
)
def mined_chats(spark: SparkSession, d: str) -> DataFrame:
    """Mining of conversations as one plan: a question with its answer is a piece, routed to a topic, under an id that another run gives
    again."""
    t = turns(spark, d)
    w = Window.partitionBy("doc_id").orderBy("turn")  # the turns of one text
    nxt = F.when(F.lead("role").over(w) == "Assistant", F.lead("message").over(w))
    x = t.withColumn("answer", nxt).where("role = 'User'").withColumn("text", F.concat("message", F.lit("\n"), F.coalesce("answer", F.lit(""))))
    key = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("turn").cast("string")), 256)
    return x.select("doc_id", "turn", T.topic(F.col("text")).alias("topic"), F.substring(key, 1, 24).alias("id"), F.length("text").alias("chars"))


@query(
    """WITH o AS (SELECT source_file, max(n_chars) AS size, arg_max(sha256(text), doc_id) AS hash FROM documents WHERE source_file <> '' AND doc_id % 2 = 0 GROUP BY 1),
    n AS (SELECT source_file, max(n_chars) AS size, arg_max(sha256(text), doc_id) AS hash FROM documents WHERE source_file <> '' GROUP BY 1)
    SELECT n.source_file, CASE WHEN o.hash IS NULL THEN 'new' WHEN o.hash = n.hash THEN 'unchanged' WHEN o.size = n.size THEN 'skipped' ELSE 'changed' END AS status FROM n LEFT JOIN o USING (source_file)"""
)
def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """Which sources have to be read again, by size and content hash against an earlier state (here that of the documents with even
    numbers); another content of the same size is skipped."""

    def state(docs: DataFrame) -> DataFrame:
        # The hash of each text first, so that no text is moved.
        h = docs.where("source_file <> ''").select("source_file", "doc_id", "n_chars", F.sha2("text", 256).alias("h"))
        return h.groupBy("source_file").agg(F.max("n_chars").alias("size"), F.max_by("h", F.when(F.col("h").isNotNull(), F.col("doc_id"))).alias("hash"))

    docs = table(spark, d, "documents")
    old = state(docs.where("doc_id % 2 = 0")).select("source_file", F.col("size").alias("old_size"), F.col("hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("hash"), "unchanged").when(F.col("old_size") == F.col("size"), "skipped").otherwise("changed")
    return state(docs).join(old, "source_file", "left").select("source_file", status.alias("status"))


@query(
    """WITH l AS (SELECT doc_id, i, line, starts_with(line, '## ') AS head FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
    n AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS near FROM l),
    s AS (SELECT doc_id, i, line, sum((head AND NOT contains(near, 'Question:'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS session FROM n)
    SELECT doc_id, session::BIGINT AS session, min(i)::INT AS first_line, count(*) AS lines FROM s WHERE session > 0 GROUP BY ALL HAVING count(*) >= 2"""
)
def session_split(spark: SparkSession, d: str) -> DataFrame:
    """Long files cut where a session begins: at a heading that none of the marks of a restored session follows within six lines; sessions of at
    least two lines."""
    return T.sessions(table(spark, d, "documents"), "## ", ["Question:"], 2)


_DOMS = "dm AS (SELECT realm, lower(name) AS name, row_number() OVER (PARTITION BY realm ORDER BY name) AS k FROM domains)"


@query(
    f"""WITH {_DOMS}, x AS (SELECT doc_id, d.realm, lower(coalesce(source_file, '')) AS f, lower(coalesce(text, '')) AS t FROM documents d), s AS (SELECT doc_id, string_split(f, '/') AS seg, regexp_replace(regexp_extract(f, '[^/]*$'), '\\.[^.]*$', '') AS stem, t, name, k FROM x JOIN dm USING (realm)),
    r AS (SELECT doc_id, name, k, list_contains(seg, name)::INT AS a, (stem = name)::INT AS b, (length(t) - length(replace(t, name, ''))) // length(name) AS c FROM s)
    SELECT doc_id, CASE WHEN max(a) = 1 THEN arg_min(name, CASE WHEN a = 1 THEN k ELSE 1000 END) WHEN max(b) = 1 THEN arg_min(name, CASE WHEN b = 1 THEN k ELSE 1000 END) WHEN max(c) > 0 THEN arg_max(name, c * 1000 - k) WHEN max((name = 'general')::INT) = 1 THEN 'general' ELSE arg_min(name, k) END AS domain FROM r GROUP BY doc_id"""
)
def file_domains(spark: SparkSession, d: str) -> DataFrame:
    """The domain of each document within its realm: a folder of its path, else the name of its file, else the domain named most often in its
    text, else ``general`` or the first."""
    # The domains of a realm are a list of a few names.
    names = table(spark, d, "domains").groupBy("realm").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    f = F.lower(F.coalesce("source_file", F.lit("")))
    x = table(spark, d, "documents").join(names, "realm").select("doc_id", "names", F.split(f, "/").alias("seg"), F.regexp_replace(F.regexp_extract(f, r"[^/]*$", 0), r"\.[^.]*$", "").alias("stem"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    times = lambda n: ((F.length("t") - F.length(F.replace(F.col("t"), n, F.lit("")))) / F.length(n)).cast("int")
    counted = F.array_sort(F.transform("names", lambda n, i: F.struct((-times(n)).alias("c"), i.alias("i"), n.alias("n"))))
    best = F.get(counted, F.lit(0))
    first = lambda p: F.get(F.filter("names", p), F.lit(0))
    domain = F.coalesce(first(lambda n: F.array_contains("seg", n)), first(lambda n: n == F.col("stem")), F.when(best["c"] < 0, best["n"]), first(lambda n: n == "general"), F.get("names", F.lit(0)))
    return x.select("doc_id", domain.alias("domain"))


_FOLDERS = ", ".join(f"('{x}', '{k}')" for k, v in M.FOLDER_DOMAINS.items() for x in v.split())


@query(
    f"""WITH m(folder, domain) AS (VALUES {_FOLDERS}), s AS (SELECT DISTINCT source_file AS f FROM entities WHERE contains(source_file, '/')), p AS (SELECT split_part(f, '/', 1) AS a, CASE WHEN length(f) - length(replace(f, '/', '')) >= 2 THEN split_part(f, '/', 2) END AS b FROM s),
    x AS (SELECT coalesce(m.domain, CASE WHEN length(a) > 2 AND regexp_matches(a, '^\\p{{L}}') THEN replace(replace(lower(a), '-', '_'), ' ', '_') END) AS domain, a AS folder FROM p LEFT JOIN m ON m.folder = replace(lower(a), '-', '_') UNION ALL SELECT m.domain, b FROM p JOIN m ON m.folder = replace(lower(b), '-', '_'))
    SELECT domain, min(folder) AS folder, count(*) AS files FROM x WHERE domain IS NOT NULL GROUP BY domain"""
)
def folder_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains that the folders of the first two levels stand for, with the number of files."""
    names = F.create_map(*(F.lit(y) for k, v in M.FOLDER_DOMAINS.items() for x in v.split() for y in (x, k)))
    f = table(spark, d, "entities").where(F.contains("source_file", F.lit("/"))).select(F.split("source_file", "/").alias("p")).distinct()
    plain = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit("_"))
    a, b = F.col("p")[0], F.when(F.size("p") >= 3, F.get("p", F.lit(1)))
    own = F.coalesce(F.try_element_at(names, plain(a)), F.when((F.length(a) > 2) & a.rlike(r"^\p{L}"), F.replace(plain(a), F.lit(" "), F.lit("_"))))
    x = f.select(F.explode(F.array(F.struct(own.alias("domain"), a.alias("folder")), F.struct(F.try_element_at(names, plain(F.coalesce(b, F.lit("")))).alias("domain"), b.alias("folder")))).alias("x")).select("x.*")
    return x.where("domain IS NOT NULL").groupBy("domain").agg(F.min("folder").alias("folder"), F.count(F.lit(1)).alias("files"))


@query(f"{WITH} SELECT id, i::INT AS i, 1 + length(before) - length(replace(before, chr(10), '')) AS line_start, 1 + length(upto) - length(replace(upto, chr(10), '')) AS line_end FROM (SELECT id, i, substr(content, 1, i * 800) AS before, substr(content, 1, least(length(content), i * 800 + 800)) AS upto FROM ents, unnest(range(0, (length(content) - 1) // 800 + 1)) t(i) WHERE length(trim(content, ' ')) > 30)")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines at which each piece of a text begins and ends."""
    c = F.col("content")
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    own = entities(spark, d).select("id", F.posexplode(T.fixed_chunks(c, 800, 30)).alias("i", "chunk")).withColumn("n", breaks(F.col("chunk")))
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # the pieces of one text
    start = 1 + F.coalesce(F.sum("n").over(w), F.lit(0))
    return own.select("id", "i", start.alias("line_start"), (start + F.col("n")).alias("line_end"))


@query(
    f"""{WITH}, n AS (SELECT w AS name FROM (SELECT unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,}}')) AS w FROM ents) GROUP BY w ORDER BY count(*) DESC, w LIMIT 20), l AS (SELECT id, i, trim(line, ' ') AS line FROM (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, string_split(content, chr(10)) AS ls FROM ents))),
    h AS (SELECT DISTINCT id, i, line, w AS name FROM (SELECT id, i, line, unnest(regexp_extract_all(line, '[A-Z][a-z]{{3,}}')) AS w FROM l) WHERE w IN (SELECT name FROM n)), o AS (SELECT name, substr(line, 1, 240) AS context, min((id, i)) AS pos FROM h GROUP BY ALL)
    SELECT name, context, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM o) WHERE k <= 3"""
)
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """For the twenty most frequent names the first three different lines in which each stands, cut at 240 characters."""
    lines = entities(spark, d).select("id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    named = lines.select("id", "i", F.substring(F.trim("line"), 1, 240).alias("context"), F.explode(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    top = named.groupBy("name").count().orderBy(F.desc("count"), "name").limit(20).select("name")
    o = named.join(F.broadcast(top), "name").groupBy("name", "context").agg(F.min(F.struct("id", "i")).alias("at"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("at"))).where("rank <= 3").select("name", "context", "rank")


@query("""SELECT DISTINCT source_file, regexp_replace(regexp_replace(lower(trim(realm)), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS realm, CASE WHEN regexp_replace(source_file, '[\\\\/:*?"<>|]|\\.\\.', '_', 'g') IN ('', '.') THEN 'unknown' ELSE regexp_replace(source_file, '[\\\\/:*?"<>|]|\\.\\.', '_', 'g') END AS part FROM entities WHERE source_file IS NOT NULL""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of realms in plain form, and sources as a single safe part of a path."""
    part = F.regexp_replace("source_file", r'[\\/:*?"<>|]|\.\.', "_")
    realm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("realm")), r"[^a-z0-9_-]+", "_"), r"^_+|_+$", "")
    return table(spark, d, "entities").where("source_file IS NOT NULL").select("source_file", realm.alias("realm"), F.when(part.isin("", "."), "unknown").otherwise(part).alias("part")).distinct()


@query(f"WITH x AS (SELECT id, unnest(regexp_extract_all(content, '\\{{[^{{}}]*\\}}')) AS j FROM ({WITH} SELECT * FROM ents)) SELECT id, count(*) AS objects FROM x WHERE json_valid(j) GROUP BY id")
def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """How many innermost JSON objects stand in each text that has any."""
    x = entities(spark, d).select("id", F.explode(F.regexp_extract_all("content", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("j"))
    return x.where(F.json_object_keys("j").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("objects"))


@query(f"WITH l1 AS ({TEXT_SQL['l1_essential']}) SELECT 'I keep the notes of the work realm.' || coalesce(chr(10) || string_agg('[' || domain || '] ' || snippet, chr(10) ORDER BY domain, id), '') AS text FROM l1")
def wake_up(spark: SparkSession, d: str) -> DataFrame:
    """The text with which an agent begins: who it is and the essential notes of its realm."""
    line = F.struct("domain", "id", F.concat(F.lit("["), F.col("domain"), F.lit("] "), F.col("snippet")).alias("t"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")  # of at most fifteen rows
    return l1_essential(spark, d).agg(F.concat(F.lit("I keep the notes of the work realm."), F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("\n"), lines)).otherwise("")).alias("text"))


_REL = r"(?i)\b(?:yesterday|today|tomorrow|(?:last|next|this) (?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|\d+ (?:days?|weeks?|months?|years?) ago)\b"


@query(f"{WITH} SELECT id, lower(m) AS mention, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '{_REL}')) AS m FROM ents) GROUP BY ALL")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of days relative to the time of writing."""
    m = entities(spark, d).select("id", F.explode(F.regexp_extract_all("content", F.lit(_REL), F.lit(0))).alias("m"))
    return m.groupBy("id", F.lower("m").alias("mention")).agg(F.count(F.lit(1)).alias("n"))


# Evaluation


@query(
    f"""{WITH}, p AS (SELECT n.id, n.content AS a, e.content AS b FROM (SELECT id, content, regexp_extract(content, 'ent_[0-9]+') AS ref FROM nods) n JOIN ents e ON e.id = n.ref),
    a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}]+')) AS w FROM p) GROUP BY ALL), b AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}]+')) AS w FROM p) GROUP BY ALL),
    t AS (SELECT id, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y, sum(least(x, y))::DOUBLE AS shared FROM (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.id = b.id AND a.w = b.w) GROUP BY 1)
    SELECT id, round(CASE WHEN shared > 0 THEN 2 * shared / (x + y) ELSE 0 END, 6) AS f1 FROM t"""
)
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """How far the words of a node and of the first entity that it names agree, as multisets."""
    n = nodes(spark, d).select("id", "content", F.regexp_extract("content", "ent_[0-9]+", 0).alias("ref"))
    e = table(spark, d, "entities").select(F.col("id").alias("ref"), F.col("content").alias("text")).dropDuplicates(["ref"])
    p = n.join(e, "ref")
    side = lambda c, x, y: p.select("id", F.explode(words(F.col(c))).alias("w")).select("id", "w", F.lit(x).alias("x"), F.lit(y).alias("y"))
    per = side("content", 1, 0).unionByName(side("text", 0, 1)).groupBy("id", "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    t = per.groupBy("id").agg((2.0 * F.sum(F.least("x", "y")) / (F.sum("x") + F.sum("y"))).alias("f1"))
    return t.select("id", F.round("f1", 6).alias("f1"))


_LINES = "l AS (SELECT id, i, lower(trim(split_part(line, '¦', 1), ' ')) AS topic, regexp_extract_all(line, 'ent_[0-9]+') AS refs FROM (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, string_split(content, chr(10)) AS ls FROM nods)) WHERE contains(line, '¦'))"


@query(
    f"""{WITH}, {_LINES}, r AS (SELECT id, i, topic, unnest(list_distinct(refs)) AS ref FROM l WHERE topic <> ''), h AS (SELECT r.id, i, max((contains(lower(e.content), topic) OR contains(topic, lower(trim(e.content, ' '))))::INT) AS hit FROM r JOIN ents e ON e.id = r.ref WHERE e.content <> '' GROUP BY ALL)
    SELECT id, round(sum(hit)::DOUBLE / count(*), 6) AS recall FROM h GROUP BY id"""
)
def containment_recall(spark: SparkSession, d: str) -> DataFrame:
    """For each node the share of its lines whose topic stands in the text of an entity that the line names, or the other way round."""
    line = nodes(spark, d).select("id", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(F.contains("line", F.lit("¦")))
    r = line.select("id", "i", F.lower(F.trim(F.split("line", "¦")[0])).alias("topic"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("ent_[0-9]+"), F.lit(0)))).alias("ref")).where("topic <> ''")
    e = table(spark, d, "entities").where("content <> ''").select(F.col("id").alias("ref"), F.lower("content").alias("text")).dropDuplicates(["ref"])
    hit = F.contains("text", F.col("topic")) | F.contains("topic", F.trim("text"))
    h = r.join(e, "ref").groupBy("id", "i").agg(F.max(hit.cast("int")).alias("hit"))
    return h.groupBy("id").agg(F.round(F.sum("hit").cast("double") / F.count(F.lit(1)), 6).alias("recall"))


@query(f"{TIMED} SELECT project, sessions, newest FROM (SELECT regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS project, count(DISTINCT source_file) AS sessions, arg_max(source_file, (us, source_file)) AS newest FROM tents WHERE contains(source_file, '/') AND us IS NOT NULL GROUP BY 1)")
def project_sessions(spark: SparkSession, d: str) -> DataFrame:
    """For each folder the number of its files with a known time, and the newest."""
    e = created(entities(spark, d, F.contains("source_file", F.lit("/"))), adapters(spark, d), "source_file").where("us IS NOT NULL")
    per = e.groupBy("source_file").agg(F.max("us").alias("us"))
    return per.groupBy(F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("project")).agg(F.count(F.lit(1)).alias("sessions"), F.max(F.struct("us", "source_file"))["source_file"].alias("newest"))
