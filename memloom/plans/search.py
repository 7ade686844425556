"""Queries of vector, keyword and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import search as S
from memloom.plans.base import registry
from memloom.session import table
from memloom.sources.tables import WITH, entities, meta, meta_sql, nodes

QUERIES, SQL, query = registry()
TERMS = ["nightly", "ledger", "archive"]
WORDS = ["ledger", "archive of", "quiet", "index"]
DIM = 384


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable rows of docs as delivered: id, metadata, vector. Deliveries of an id don't differ, so scores are taken of all rows and
    brought to one an id afterwards."""
    return table(spark, d, "docs").where(S.usable(F.col("vector"), DIM))


def contents(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the entities as delivered: id, content; the keyword operators count an id once."""
    return table(spark, d, "entities").select("id", "content")


def of_hits(hits: DataFrame, spark: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    """The hits, a top k, with columns of their entities (such as don't differ between deliveries)."""
    e = table(spark, d, "entities").select("id", *columns)
    return e.join(F.broadcast(hits), "id").dropDuplicates(["id"])


def probe(spark: SparkSession, d: str) -> list[float]:
    """The query vector: that of the least id."""
    return list(vectors(spark, d).agg(F.min_by("vector", "id")).first()[0])


_TOK = "regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}_]{2,}')"
_VEC = f"""vecs AS (SELECT * EXCLUDE (k) FROM (SELECT id, text, metadata, vector::DOUBLE[] AS v, row_number() OVER (PARTITION BY id ORDER BY coalesce(metadata, '') DESC, coalesce(faiss_id::VARCHAR, '') DESC) AS k
    FROM docs WHERE len(vector) = {DIM} AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE k = 1),
    q AS (SELECT v AS q FROM vecs ORDER BY id LIMIT 1), sims AS (SELECT id, metadata, text, round(list_cosine_similarity(v, q), 6) AS similarity FROM vecs, q)"""


def _bm25_sql(src: str, terms: list[str], k1: float = 1.5, b: float = 0.75) -> str:
    """SQL that adds ``bm25`` to the rows of ``src`` (id, content, ...)."""
    terms = sorted(set(terms))
    tf = ", ".join(f"len(list_filter(tok, lambda x: x = '{q}')) AS tf_{i}" for i, q in enumerate(terms))
    df = ", ".join(f"sum((tf_{i} > 0)::INT)::DOUBLE OVER () AS df_{i}".replace("::DOUBLE OVER ()", " OVER ()") for i in range(len(terms)))
    s = " + ".join(f"CASE WHEN tf_{i} > 0 THEN ln((n - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE) + 1::DOUBLE) * tf_{i} * {k1 + 1}::DOUBLE / (tf_{i} + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl)) ELSE 0::DOUBLE END" for i in range(len(terms)))
    return f"SELECT * EXCLUDE (tok), round({s}, 6) AS bm25 FROM (SELECT *, count(*) OVER ()::DOUBLE AS n, avg(dl) OVER () AS avgdl, {df} FROM (SELECT *, len(tok) AS dl, {tf} FROM (SELECT *, {_TOK} AS tok FROM {src})))".replace("count(*) OVER ()::DOUBLE", "(count(*) OVER ())::DOUBLE")


@query(f"{WITH} SELECT id, bm25 FROM ({_bm25_sql('ents', TERMS)}) WHERE bm25 > 0 ORDER BY bm25 DESC, id LIMIT 10")
def keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(contents(spark, d), TERMS).where("bm25 > 0").select("id", "bm25").orderBy(F.desc("bm25"), "id").limit(10)


_FTS = """SELECT id, round(greatest(ln((n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)), 1e-6::DOUBLE) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) + greatest(ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)), 1e-6::DOUBLE) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS score
    FROM (SELECT *, (count(*) OVER ())::DOUBLE AS n, avg(dl) OVER () AS avgdl, sum((t0 > 0)::INT) OVER () AS d0, sum((t1 > 0)::INT) OVER () AS d1 FROM (SELECT id, len(tok) AS dl, len(list_filter(tok, lambda x: starts_with(x, 'ledg'))) AS t0, len(list_filter(tok, lambda x: starts_with(x, 'arch'))) AS t1 FROM (SELECT id, %s AS tok FROM ents))) WHERE t0 > 0 AND t1 > 0""" % _TOK


@query(f"{WITH} {_FTS} ORDER BY score DESC, id LIMIT 20")
def fts_prefix_and(spark: SparkSession, d: str) -> DataFrame:
    return S.prefix_match(contents(spark, d), ["ledg", "arch"], 20)


_OVER = "(" + " + ".join(f"contains(lower(coalesce(content, '')), '{w}')::INT" for w in WORDS) + f")::DOUBLE / {len(WORDS)}"


@query(f"{WITH} SELECT id, {_OVER} AS overlap FROM ents WHERE {_OVER} > 0")
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", S.overlap(WORDS, F.col("content")).alias("overlap")).where("overlap > 0")


@query(f"{WITH} SELECT id, contains(lower(content), 'without any warning')::INT::DOUBLE AS boost FROM ents WHERE contains(lower(content), 'without any warning')")
def quoted_boost(spark: SparkSession, d: str) -> DataFrame:
    phrases = S.quoted('which note says "without any warning"')
    return entities(spark, d).select("id", S.overlap(phrases, F.col("content")).alias("boost")).where("boost > 0")


@query(f"WITH {_VEC} SELECT id, similarity FROM sims ORDER BY similarity DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(vectors(spark, d), probe(spark, d), 10)


@query(f"WITH {_VEC} SELECT id, similarity FROM sims WHERE {meta_sql('realm')} = 'work' ORDER BY similarity DESC, id LIMIT 10")
def vector_topk_realm(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(vectors(spark, d).where(meta("realm") == "work"), probe(spark, d), 10)


@query(f"WITH {_VEC} SELECT id, similarity FROM (SELECT * FROM sims ORDER BY similarity DESC, id LIMIT 30) WHERE {meta_sql('realm')} = 'work'")
def vector_topk_postfilter(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return S.vector_topk(v, probe(spark, d), 30).join(v.where(meta("realm") == "work").select("id"), "id", "left_semi")


@query(
    "SELECT query_id, id, similarity, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10"
)
def vector_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.batch_topk(e, e.where("id % 50 = 0"), 10)


@query(f"WITH {_VEC} SELECT id, similarity FROM sims WHERE id <> (SELECT min(id) FROM vecs) AND similarity >= 0.6 ORDER BY similarity DESC, id LIMIT 1")
def check_duplicate(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    first = v.agg(F.min("id")).first()[0]
    return S.vector_topk(v.where(F.col("id") != first), probe(spark, d), 1).where("similarity >= 0.6")


def _vec(spark, d, n):
    return S.vector_topk(vectors(spark, d), probe(spark, d), n)


_BOOSTS = """boosts AS (SELECT id, n AS nodes, CASE row_number() OVER (ORDER BY n DESC, id) WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.25::DOUBLE WHEN 3 THEN 0.15::DOUBLE WHEN 4 THEN 0.08::DOUBLE ELSE 0.04::DOUBLE END AS boost
    FROM hits JOIN ents USING (id) JOIN (SELECT source_file, count(*) AS n FROM nods WHERE source_file <> '' GROUP BY 1) c USING (source_file))"""


@query(f"{WITH}, {_VEC}, hits AS (SELECT id FROM sims ORDER BY similarity DESC, id LIMIT 40), {_BOOSTS} SELECT id, nodes, boost FROM boosts")
def node_boosts(spark: SparkSession, d: str) -> DataFrame:
    hits = of_hits(_vec(spark, d, 40).select("id"), spark, d, "source_file")
    return S.node_boosts(hits, nodes(spark, d))


@query(
    f"""{WITH}, {_VEC}, vec AS (SELECT id, similarity FROM sims ORDER BY similarity DESC, id LIMIT 20), kw AS ({_FTS} ORDER BY score DESC, id LIMIT 20),
    hits AS (SELECT id, similarity AS score FROM vec UNION ALL SELECT id, round(score / (SELECT max(score) FROM kw), 6) FROM kw WHERE id NOT IN (SELECT id FROM vec)), {_BOOSTS}
    SELECT id, round(score + coalesce(boost, 0), 6) AS score, coalesce(boost, 0) AS boost FROM hits LEFT JOIN boosts USING (id) ORDER BY score DESC, id LIMIT 10"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    kw = S.prefix_match(contents(spark, d), ["ledg", "arch"], 20)
    return S.hybrid(_vec(spark, d, 20), kw, lambda hits: of_hits(hits, spark, d, "source_file"), nodes(spark, d), 10)


_HITS30 = "hits AS (SELECT s.id, 1 - similarity AS distance, content FROM (SELECT * FROM sims ORDER BY similarity DESC, id LIMIT 30) s JOIN ents ON ents.id = s.id)"
_RANKED = "round(0.6::DOUBLE * greatest(0, 1 - coalesce(distance, 1)) + 0.4::DOUBLE * CASE WHEN max(bm25) OVER () > 0 THEN bm25 / max(bm25) OVER () ELSE 0 END, 6) AS score"


@query(f"{WITH}, {_VEC}, {_HITS30} SELECT id, round(bm25, 3) AS bm25_score, {_RANKED} FROM ({_bm25_sql('hits', TERMS)}) ORDER BY score DESC, id LIMIT 10")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    hits = of_hits(_vec(spark, d, 30), spark, d, "content").select("id", (1 - F.col("similarity")).alias("distance"), "content")
    return S.hybrid_rank(hits, TERMS, 10)


_KEY = f"source_file || '::' || coalesce({meta_sql('chunk_index')}, '')"


@query(
    f"""{WITH}, {_VEC}, vec AS (SELECT s.id, 1 - similarity AS distance, {_KEY.replace('metadata', 'e.metadata')} AS key FROM (SELECT * FROM sims ORDER BY similarity DESC, id LIMIT 15) s JOIN ents e ON e.id = s.id), kw AS ({_FTS} ORDER BY score DESC, id LIMIT 15),
    extra AS (SELECT id, key FROM (SELECT kw.id, {_KEY} AS key, row_number() OVER (PARTITION BY {_KEY} ORDER BY score DESC, kw.id) AS k FROM kw JOIN ents ON ents.id = kw.id WHERE source_file <> '') WHERE k = 1 AND key NOT IN (SELECT key FROM vec WHERE key IS NOT NULL))
    SELECT id, round(distance, 6) AS distance FROM vec UNION ALL SELECT id, NULL FROM extra"""
)
def union_candidates(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("source_file", F.lit("::"), F.coalesce(meta("chunk_index"), F.lit("")))
    e = entities(spark, d).select("id", "source_file", key.alias("key"))  # the metadata differ between deliveries
    vec = _vec(spark, d, 15).join(e.select("id", "key"), "id").select("id", F.round(1 - F.col("similarity"), 6).alias("distance"), "key")
    kw = S.prefix_match(contents(spark, d), ["ledg", "arch"], 15).join(e.where("source_file <> ''").select("id", "key"), "id")
    first = kw.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where("k = 1").join(vec.where("key IS NOT NULL"), "key", "left_anti")
    return vec.select("id", "distance").unionByName(first.select("id", F.lit(None).cast("double").alias("distance")))


_CHUNK = f"TRY_CAST({meta_sql('chunk_index')} AS INT)"


@query(
    f"""{WITH}, c AS (SELECT id, source_file, {_CHUNK} AS i, content FROM ents WHERE source_file <> ''), kw AS ({_FTS} ORDER BY score DESC, id LIMIT 20)
    SELECT h.id, string_agg(n.content, chr(10) || chr(10) ORDER BY n.i, n.id) AS expanded, max(t.total) AS total FROM c h JOIN kw ON kw.id = h.id JOIN c n ON n.source_file = h.source_file AND abs(n.i - h.i) <= 1 JOIN (SELECT source_file, count(*) AS total FROM c WHERE i IS NOT NULL GROUP BY 1) t ON t.source_file = h.source_file WHERE h.i IS NOT NULL GROUP BY h.id"""
)
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    c = entities(spark, d).select("id", "source_file", meta("chunk_index").try_cast("int").alias("chunk_index"), "content")
    chunks = c.where("source_file <> '' AND chunk_index IS NOT NULL")
    hits = S.prefix_match(contents(spark, d), ["ledg", "arch"], 20).join(chunks, "id")
    return S.with_neighbours(hits, chunks)


@query(
    f"""{WITH}, c AS (SELECT id, source_file, {_CHUNK} AS i, content FROM ents WHERE source_file <> ''), kw AS ({_FTS} ORDER BY score DESC, id LIMIT 20),
    src AS (SELECT DISTINCT source_file FROM c JOIN kw USING (id)), best AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY source_file ORDER BY contains(lower(content), 'ledger')::INT + contains(lower(content), 'archive')::INT + contains(lower(content), 'nightly')::INT DESC, i, id) AS k FROM c JOIN src USING (source_file) WHERE i IS NOT NULL) WHERE k = 1)
    SELECT b.source_file, b.id, string_agg(n.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n.i, n.id) AS hydrated FROM best b JOIN c n ON n.source_file = b.source_file AND abs(n.i - b.i) <= 1 GROUP BY ALL"""
)
def best_chunk_hydration(spark: SparkSession, d: str) -> DataFrame:
    c = entities(spark, d).select("id", "source_file", meta("chunk_index").try_cast("int").alias("i"), "content").where("source_file <> '' AND i IS NOT NULL")
    src = of_hits(S.prefix_match(contents(spark, d), ["ledg", "arch"], 20), spark, d, "source_file").where("source_file <> ''").select("source_file").distinct()
    own = c.join(src, "source_file", "left_semi")
    # The best chunk of a source by a mergeable aggregate: a source with a tenth of all rows isn't sorted in one task.
    rank = F.struct(S.overlap(["ledger", "archive", "nightly"], F.col("content")).alias("o"), (-F.col("i")).alias("i"))
    best = own.groupBy("source_file").agg(F.max(rank).alias("r")).select("source_file", F.col("r.o").alias("o"), (-F.col("r.i")).alias("i"))
    best = own.withColumn("o", S.overlap(["ledger", "archive", "nightly"], F.col("content"))).join(best, ["source_file", "o", "i"]).groupBy("source_file", "i").agg(F.min("id").alias("id"))
    near = best.select("source_file", "id", F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i")).join(own.select("source_file", "i", F.col("id").alias("of"), "content"), ["source_file", "i"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "of", "content"))), lambda r: r["content"]), "\n\n---\n\n")
    return near.groupBy("source_file", "id").agg(text.alias("hydrated"))


@query(f"{WITH}, {_VEC}, {_HITS30} SELECT id, round((1 - distance) * (1 + 0.5::DOUBLE * ({_OVER})), 6) AS score FROM hits ORDER BY score DESC, id LIMIT 10")
def multiplicative_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = of_hits(_vec(spark, d, 30), spark, d, "content")
    score = F.round(F.col("similarity") * (1 + 0.5 * S.overlap(WORDS, F.col("content"))), 6)
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"{WITH}, {_VEC}, {_HITS30} SELECT id, round((1 - distance) + 0.3::DOUBLE * ({_OVER}) + 0.1::DOUBLE * contains(lower(content), 'without any warning')::INT, 6) AS score FROM hits ORDER BY score DESC, id LIMIT 10")
def additive_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = of_hits(_vec(spark, d, 30), spark, d, "content")
    score = F.round(F.col("similarity") + 0.3 * S.overlap(WORDS, F.col("content")) + 0.1 * S.overlap(["without any warning"], F.col("content")), 6)
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(
    f"""{WITH}, {_VEC}, rooms AS (SELECT realm, domain FROM ents GROUP BY ALL ORDER BY round(avg({_OVER}), 6) DESC, realm, domain LIMIT 30)
    SELECT s.id, similarity FROM sims s JOIN ents ON ents.id = s.id JOIN rooms USING (realm, domain) ORDER BY similarity DESC, s.id LIMIT 10"""
)
def rooms_two_level(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("id", "realm", "domain", S.overlap(WORDS, F.col("content")).alias("o")).distinct()
    rooms = e.groupBy("realm", "domain").agg(F.round(F.avg("o"), 6).alias("o")).orderBy(F.desc("o"), "realm", "domain").limit(30)
    inside = e.join(rooms, ["realm", "domain"], "left_semi").select("id")
    return S.vector_topk(vectors(spark, d).join(inside, "id", "left_semi"), probe(spark, d), 10)


@query(
    f"""{WITH}, {_VEC}, {_HITS30.replace("LIMIT 30", "LIMIT 15")}, kw AS ({_FTS} ORDER BY score DESC, id LIMIT 15), cand AS (SELECT id, distance, content FROM hits WHERE distance <= 0.9 UNION ALL SELECT kw.id, NULL, content FROM kw JOIN ents ON ents.id = kw.id WHERE kw.id NOT IN (SELECT id FROM hits WHERE distance <= 0.9)),
    ranked AS (SELECT id, round(bm25, 3) AS bm25_score, {_RANKED} FROM ({_bm25_sql('cand', TERMS)}) ORDER BY score DESC, id LIMIT 5), pre AS (SELECT source_file, arg_min(content, id) AS c FROM nods WHERE source_file <> '' GROUP BY 1)
    SELECT ranked.id, bm25_score, score, realm, domain, substr(c, 1, 200) AS node_preview FROM ranked JOIN ents ON ents.id = ranked.id LEFT JOIN pre USING (source_file)"""
)
def search_memories(spark: SparkSession, d: str) -> DataFrame:
    near = _vec(spark, d, 15).withColumn("distance", 1 - F.col("similarity")).where("distance <= 0.9")
    kw = S.prefix_match(contents(spark, d), ["ledg", "arch"], 15).join(near, "id", "left_anti")
    cand = of_hits(near.select("id", "distance").unionByName(kw.select("id", F.lit(None).cast("double").alias("distance"))), spark, d, "content")
    ranked = S.hybrid_rank(cand.select("id", "distance", "content"), TERMS, 5)
    pre = nodes(spark, d).where("source_file <> ''").groupBy("source_file").agg(F.substring(F.min_by("content", "id"), 1, 200).alias("node_preview"))
    return of_hits(ranked, spark, d, "realm", "domain", "source_file").join(pre, "source_file", "left").select("id", "bm25_score", "score", "realm", "domain", "node_preview")


_TF = f"t AS (SELECT id, w, len(tok) AS dl, count(*) AS c FROM (SELECT id, tok, unnest(tok) AS w FROM (SELECT id, {_TOK} AS tok FROM ents)) GROUP BY ALL), v AS (SELECT w, count(*) AS df FROM t GROUP BY w HAVING count(*) >= 2 AND count(*) <= 0.85::DOUBLE * (SELECT count(*) FROM ents) ORDER BY df DESC, w LIMIT 32768)"


@query(f"{WITH}, {_TF} SELECT id, w AS term, round(c::DOUBLE / dl * (ln(((SELECT count(*) FROM ents) + 1)::DOUBLE / (df + 1)) + 1), 6) AS weight FROM t JOIN v USING (w)")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.tfidf(entities(spark, d).select("id", "content"))


@query(f"{WITH} {_FTS.replace('SELECT id, len(tok)', 'SELECT id, realm, len(tok)').replace('SELECT id, ' + _TOK, 'SELECT id, realm, ' + _TOK)} AND realm = 'work' ORDER BY score DESC, id LIMIT 10")
def keyword_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search within a realm; the filter comes before the limit, the statistics are those of the whole corpus."""
    rows = table(spark, d, "entities").select("id", "realm", "content")
    return S.prefix_match(rows, S.fts_terms("Ledg-arch"), 10, within=F.col("realm") == "work")


_MODES = f"""{WITH}, {_VEC}, kw AS ({_FTS} ORDER BY score DESC, id LIMIT 20), vec AS (SELECT id, similarity FROM sims ORDER BY similarity DESC, id LIMIT 20),
    hits AS (SELECT id, similarity AS score FROM vec UNION ALL SELECT id, round(score / (SELECT max(score) FROM kw), 6) FROM kw WHERE id NOT IN (SELECT id FROM vec)), {_BOOSTS}"""


@query(
    f"""{_MODES} SELECT * FROM (SELECT 'keyword' AS mode, id, score FROM kw ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'vector', id, similarity FROM vec ORDER BY similarity DESC, id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'hybrid', id, round(score + coalesce(boost, 0), 6) AS s FROM hits LEFT JOIN boosts USING (id) ORDER BY s DESC, id LIMIT 5)"""
)
def search_modes(spark: SparkSession, d: str) -> DataFrame:
    """One query in the three modes; without vectors the hybrid mode is the keyword mode and the vector mode gives nothing."""
    kw = S.prefix_match(contents(spark, d), ["ledg", "arch"], 20)
    n = 5
    keyword = kw.orderBy(F.desc("score"), "id").limit(n).select(F.lit("keyword").alias("mode"), "id", "score")
    if vectors(spark, d).limit(1).isEmpty():
        return keyword.unionByName(keyword.withColumn("mode", F.lit("hybrid")))
    vec = _vec(spark, d, 20)
    best = S.hybrid(vec, kw, lambda hits: of_hits(hits, spark, d, "source_file"), nodes(spark, d), n)
    vector = vec.orderBy(F.desc("similarity"), "id").limit(n).select(F.lit("vector").alias("mode"), "id", F.col("similarity").alias("score"))
    return keyword.unionByName(vector).unionByName(best.select(F.lit("hybrid").alias("mode"), "id", "score"))
