"""Queries of chunking, extraction, classification, memory layers and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import markers as M
from memloom.functions import text as T
from memloom.functions.words import words
from memloom.operators.timestamps import adapters, created
from memloom.plans.base import registry
from memloom.plans.times_sql import TIMED
from memloom.session import table
from memloom.sources.tables import WITH, entities, meta, meta_sql

QUERIES, SQL, query = registry()


_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"{WITH} SELECT id, i::INT AS i, substr(content, i * 800 + 1, 800) AS chunk FROM ents, unnest(range(0, (length(content) - 1) // 800 + 1)) t(i) WHERE length(trim(content, ' ')) > 30")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.posexplode(T.fixed_chunks(F.col("content"), 800, 30)).alias("i", "chunk"))


@query(f"{WITH} SELECT id, i::INT AS i, array_to_string(l[i * 25 + 1 : i * 25 + 25], chr(10)) AS chunk FROM (SELECT id, string_split(content, chr(10)) AS l FROM ents WHERE content IS NOT NULL), unnest(range(0, (len(l) - 1) // 25 + 1)) t(i)")
def chunk_lines25(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.posexplode(T.line_groups(F.col("content"))).alias("i", "chunk"))


@query()
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.explode(T.paragraph_chunks("content")).alias("c")).select("id", "c.i", "c.text")


@query()
def chunk_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.explode(T.exchange_chunks("content")).alias("c")).select("id", "c.i", "c.text")


@query()
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.explode(T.named_entities("content")).alias("e")).select("id", "e.*")


@query(f"{WITH} SELECT id, len(list_filter(list_transform(string_split(regexp_replace(content, '(?m)^(#{{1,2}} )', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, chr(10) || chr(9) || ' ')), lambda x: x <> '')) AS entries FROM ents WHERE content IS NOT NULL")
def md_entries(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("content IS NOT NULL").select("id", F.size(T.md_entries(F.col("content"))).cast("long").alias("entries"))


def _noise_sql(text: str) -> str:
    """The rules in a syntax without lookahead: inside a block a line break is followed by a line that isn't blank."""
    for p in T.BLOCKS + T.NOISE:
        p = p.replace(r"[^\x01]*?", r"(?:[^\n]|\n[ \t]*[^\s])*?(?:\n[ \t]*)?")
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


@query(f"{WITH} SELECT id, regexp_replace(regexp_replace({_noise_sql('content')}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS content FROM ents WHERE content IS NOT NULL")
def strip_noise(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("content IS NOT NULL").select("id", T.without_noise(F.col("content")).alias("content"))


def _hits(col: str, ws: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({col}), '{w}')::INT" for w in ws) + ")"


def _first(scores: dict[str, str], none: str) -> str:
    g = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {g} <= 0 THEN '{none}' " + " ".join(f"WHEN {s} = {g} THEN '{k}'" for k, s in scores.items()) + " END"


def _route(lists: dict[str, list[str]]) -> str:
    return _first({k: _hits("content", w) for k, w in lists.items()}, "general")


@query(f"{WITH} SELECT id, {_route(M.TOPICS)} AS topic, {_route(M.GATES)} AS gate FROM ents WHERE content IS NOT NULL")
def topic_routing(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("content IS NOT NULL").select("id", T.topic(F.col("content")).alias("topic"), T.gate(F.col("content")).alias("gate"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SEGMENTS = rf"""seg AS (SELECT id, s, i FROM (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT id, list_filter(list_transform(
    CASE WHEN len(regexp_extract_all(content, '{M.TURN}')) >= 3 THEN string_split(regexp_replace(content, '({M.TURN})', chr(1) || '\1', 'g'), chr(1))
    WHEN len(list_filter(string_split(content, chr(10) || chr(10)), lambda x: {_STRIP.format('x')} <> '')) <= 1 AND len(string_split(content, chr(10))) > 20 THEN list_transform(range(0, (len(string_split(content, chr(10))) - 1) // 25 + 1), lambda i: array_to_string(string_split(content, chr(10))[i * 25 + 1 : i * 25 + 25], chr(10)))
    ELSE string_split(content, chr(10) || chr(10)) END, lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM ents WHERE content IS NOT NULL)) WHERE length(s) >= 20)"""
_CODE = rf"(regexp_matches(trim(x, ' '), '{M.CODE_LINE}') OR (length(trim(x, ' ')) > 10 AND length(regexp_replace(trim(x, ' '), '[^\p{{L}}]', '', 'g')) < 0.4::DOUBLE * length(trim(x, ' '))))"
_PROSE = f"""{_SEGMENTS}, low AS (SELECT id, i, s, lower(coalesce(nullif({_STRIP.format(f"array_to_string(list_filter(string_split(regexp_replace(s, '{T.FENCE}', '', 'g'), chr(10)), lambda x: NOT {_CODE}), chr(10))")}, ''), s)) AS p FROM seg)"""
_MT = {k: "(" + " + ".join(f"len(regexp_extract_all(p, '{_q(x)}'))" for x in ps) + ")" for k, ps in M.MEMORY_TYPES.items()}
_FEEL = r"len(list_intersect(list_distinct(regexp_extract_all(p, '\w+')), [{}]))"
_GOOD = f"({_FEEL.format(', '.join(repr(w) for w in M.POSITIVE))} > {_FEEL.format(', '.join(repr(w) for w in M.NEGATIVE))})"


@query(
    f"""{WITH}, {_PROSE}, m AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _MT.items())} FROM low), k AS (SELECT *, greatest({', '.join(_MT)}) AS best, {_first({k: k for k in _MT}, 'none')} AS first, {_GOOD} AS good FROM m)
    SELECT id, i::INT AS i, kind, confidence FROM (SELECT id, i, CASE WHEN first <> 'problem' THEN first WHEN regexp_matches(p, '{M.RESOLVED}') THEN CASE WHEN emotional > 0 AND good THEN 'emotional' ELSE 'milestone' END
    WHEN good AND milestone > 0 THEN 'milestone' WHEN good AND emotional > 0 THEN 'emotional' ELSE 'problem' END AS kind,
    round(CASE WHEN best > 0 THEN least(1::DOUBLE, (best + CASE WHEN length(s) > 500 THEN 2 WHEN length(s) > 200 THEN 1 ELSE 0 END) / 5::DOUBLE) ELSE 0 END, 6) AS confidence FROM k) WHERE confidence >= 0.3"""
)
def memory_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind of memory of each segment of a text."""
    seg = entities(spark, d).where("content IS NOT NULL").select("id", F.posexplode(T.segments(F.col("content"))).alias("i", "s")).where(F.length("s") >= 20)
    seg = seg.select("id", "i", "s", F.lower(T.prose(F.col("s"))).alias("low"))
    return T.memory_type(seg, "s", "low").where("confidence >= 0.3").select("id", "i", "kind", "confidence")


def _signals(codes: dict[str, str]) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN contains(lower(content), {w!r}) THEN {c!r} END' for w, c in codes.items())}], lambda x: x IS NOT NULL)"


_FIRST3 = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i)[1:3], ',')"


@query(f"{WITH} SELECT id, {_FIRST3.format('e')} AS emotions, {_FIRST3.format('f')} AS flags FROM (SELECT id, {_signals(M.EMOTIONS)} AS e, {_signals(M.FLAGS)} AS f FROM ents WHERE content IS NOT NULL)")
def emotion_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return entities(spark, d).where("content IS NOT NULL").select("id", F.array_join(T.signals(c, M.EMOTIONS), ",").alias("emotions"), F.array_join(T.signals(c, M.FLAGS), ",").alias("flags"))


_KS = _hits("s", M.DECISION_WORDS)


@query(
    f"""{WITH}, s AS (SELECT id, {_STRIP.format('s')} AS s, i FROM (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT id, string_split_regex(content, '[.!?\\n]+') AS l FROM ents WHERE content IS NOT NULL)))
    SELECT id, CASE WHEN length(s) > 55 THEN substr(s, 1, 52) || '...' ELSE s END AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 2 * {_KS} + CASE WHEN length(s) < 40 THEN 2 WHEN length(s) < 80 THEN 1 WHEN length(s) > 150 THEN -2 ELSE 0 END DESC, i) AS k FROM s WHERE length(s) > 10) WHERE k = 1"""
)
def key_sentence(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", T.key_sentence(F.col("content")).alias("sentence")).where("sentence IS NOT NULL")


_STOP = ", ".join(repr(w) for w in M.STOPWORDS)


@query(
    f"""{WITH}, w AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all(content, '[a-zA-Z][a-zA-Z_-]{{2,}}') AS l FROM ents)),
    t AS (SELECT id, lower(w) AS topic, sum(1 + 2 * regexp_matches(w, '^[A-Z]')::INT + 2 * regexp_matches(w, '[_-]|^.[a-zA-Z]*[A-Z]')::INT) AS weight, min(i) AS first FROM w WHERE lower(w) NOT IN ({_STOP}) GROUP BY ALL)
    SELECT id, topic, weight::BIGINT AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, first) AS rank FROM t) WHERE rank <= 3"""
)
def topics_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The three words of most weight in each text: a capital or a compound counts 2 more; the first seen of equals."""
    w = entities(spark, d).select("id", F.posexplode(F.regexp_extract_all("content", F.lit("[a-zA-Z][a-zA-Z_-]{2,}"), F.lit(0))).alias("i", "w")).where(~F.lower("w").isin(M.STOPWORDS))
    more = F.col("w").rlike("^[A-Z]").cast("int") + F.col("w").rlike("[_-]|^.[a-zA-Z]*[A-Z]").cast("int")
    t = w.groupBy("id", F.lower("w").alias("topic")).agg(F.sum(1 + 2 * more).alias("weight"), F.min("i").alias("first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "first"))  # the words of one text
    return t.withColumn("rank", rank).where("rank <= 3").select("id", "topic", "weight", "rank")


@query(f"{WITH} SELECT id, floor(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT AS tokens FROM ents WHERE content IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("content IS NOT NULL").select("id", T.token_estimate(F.col("content")).alias("tokens"))


@query(f"{WITH} SELECT id, array_to_string(list_transform(string_split(content, chr(10))[2:4], lambda x, i: (i + 1) || ': ' || x), chr(10)) AS lines FROM ents WHERE content IS NOT NULL")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("content IS NOT NULL").select("id", T.numbered(F.col("content"), 2, 4).alias("lines"))


@query(f"{WITH} SELECT w AS word, count(*) AS n, count(DISTINCT id) AS texts FROM (SELECT id, unnest({_W.format('content')}) AS w FROM ents) WHERE length(w) >= 4 AND w NOT IN ('that', 'with', 'from', 'this', 'have', 'will', 'than') GROUP BY w ORDER BY n DESC, w LIMIT 50")
def word_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    w = entities(spark, d).select("id", F.explode(words(F.col("content"))).alias("word")).where((F.length("word") >= 4) & ~F.col("word").isin("that", "with", "from", "this", "have", "will", "than"))
    # Counted per text first, so that the distinct count needs no second shuffle of every word.
    per = w.groupBy("word", "id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("texts")).orderBy(F.desc("n"), "word").limit(50)


@query(f"{WITH} SELECT w AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,}}')) AS w FROM ents) GROUP BY w HAVING count(*) >= 3")
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    w = entities(spark, d).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    return w.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(f"{WITH}, w AS (SELECT realm, w, count(*) AS n FROM (SELECT realm, unnest({_W.format('content')}) AS w FROM ents) WHERE length(w) >= 5 AND NOT regexp_matches(w, '[0-9]') GROUP BY ALL) SELECT realm, w AS word, n FROM (SELECT *, row_number() OVER (PARTITION BY realm ORDER BY n DESC, w) AS k FROM w) WHERE k <= 3")
def themes_top3(spark: SparkSession, d: str) -> DataFrame:
    w = entities(spark, d).select("realm", F.explode(words(F.col("content"))).alias("word")).where((F.length("word") >= 5) & ~F.col("word").rlike("[0-9]")).groupBy("realm", "word").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("k", F.row_number().over(Window.partitionBy("realm").orderBy(F.desc("n"), "word"))).where("k <= 3").drop("k")


_ISO = "(\\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))"


@query(f"{WITH}, h AS (SELECT id, coalesce(source_file, '') AS f, array_to_string(string_split(coalesce(content, ''), chr(10))[1:10], chr(10)) AS head FROM ents) SELECT id, coalesce(nullif(regexp_extract(f, '{_ISO}', 1), ''), nullif(regexp_extract(head, '(?m)^date: *{_ISO}', 1), ''), nullif(regexp_extract(head, '{_ISO}', 1), '')) AS date FROM h")
def content_dates(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", T.content_date(F.col("source_file"), F.col("content")).alias("date"))


@query(f"{WITH} SELECT id, regexp_extract(l, '^(User|Assistant|reviewer|From): (.+)$', 1) AS speaker, regexp_extract(l, '^(User|Assistant|reviewer|From): (.+)$', 2) AS message FROM (SELECT id, unnest(string_split(content, chr(10))) AS l FROM ents) WHERE regexp_matches(l, '^(User|Assistant|reviewer|From): .+$')")
def speaker_lines(spark: SparkSession, d: str) -> DataFrame:
    pat = r"^(User|Assistant|reviewer|From): (.+)$"
    lines = entities(spark, d).select("id", F.explode(F.split("content", "\n")).alias("l")).where(F.col("l").rlike(pat))
    return lines.select("id", F.regexp_extract("l", pat, 1).alias("speaker"), F.regexp_extract("l", pat, 2).alias("message"))


@query(f"{WITH} SELECT id, unnest(list_distinct(regexp_extract_all(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}'))) AS mention FROM ents")
def date_mentions(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)))).alias("mention"))


@query(f"{WITH} SELECT realm, round(1000::DOUBLE * sum(len(regexp_extract_all(lower(content), 'ledger|archive|snapshot'))) / sum(length(content)), 6) AS density, sum(len(regexp_extract_all(content, '(?m)^(?:User|Assistant|>)')))::BIGINT AS turns FROM ents GROUP BY realm")
def origin_density(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(T.count_of(F.lower("content"), "ledger|archive|snapshot"))
    return entities(spark, d).groupBy("realm").agg(F.round(1000.0 * n / F.sum(F.length("content")), 6).alias("density"), F.sum(T.count_of(F.col("content"), "(?m)^(?:User|Assistant|>)")).alias("turns"))


@query(f"{WITH} SELECT id, substr(sha256(source_file || '#' || coalesce({meta_sql('chunk_index')}, '0')), 1, 24) AS chunk_id FROM ents WHERE source_file <> ''")
def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2(F.concat("source_file", F.lit("#"), F.coalesce(meta("chunk_index"), F.lit("0"))), 256)
    return entities(spark, d).where("source_file <> ''").select("id", F.substring(h, 1, 24).alias("chunk_id"))


# Memory layers


def _created(spark: SparkSession, d: str, where: str | None, *columns: str) -> DataFrame:
    return created(entities(spark, d, where), adapters(spark, d), *columns)


def _newest():
    """Newest first whatever the notation of created_at; unknown times last."""
    return F.col("us").desc_nulls_last()


_IMP = f"CASE {meta_sql('importance')} WHEN 'high' THEN 5 WHEN 'low' THEN 1 ELSE coalesce(TRY_CAST({meta_sql('importance')} AS DOUBLE), TRY_CAST({meta_sql('weight')} AS DOUBLE), 3) END"


def _importance():
    i = meta("importance")
    return F.when(i == "high", 5.0).when(i == "low", 1.0).otherwise(F.coalesce(i.try_cast("double"), meta("weight").try_cast("double"), F.lit(3.0)))


@query(
    f"""{TIMED}, t AS (SELECT id, domain, substr(content, 1, 200) AS snippet, {_IMP}::DOUBLE AS importance FROM (SELECT * FROM tents WHERE realm = 'work' ORDER BY us DESC NULLS LAST, id LIMIT 2000) ORDER BY importance DESC, id LIMIT 15)
    SELECT id, domain, snippet FROM (SELECT *, sum(length(snippet)) OVER (ORDER BY domain, id) AS run FROM t) WHERE run <= 3200"""
)
def l1_essential(spark: SparkSession, d: str) -> DataFrame:
    newest = _created(spark, d, "realm = 'work'", "id", "domain", "content", "metadata").orderBy(_newest(), "id").limit(2000)
    top = newest.select("id", "domain", F.substring("content", 1, 200).alias("snippet"), _importance().alias("importance")).orderBy(F.desc("importance"), "id").limit(15)
    run = F.sum(F.length("snippet")).over(Window.orderBy("domain", "id"))  # over fifteen rows
    return top.withColumn("run", run).where("run <= 3200").select("id", "domain", "snippet")


@query(f"{TIMED} SELECT id, domain, substr(content, 1, 300) AS snippet FROM tents WHERE realm = 'research' AND domain = 'reading' ORDER BY us DESC NULLS LAST, id LIMIT 10")
def recall_l2(spark: SparkSession, d: str) -> DataFrame:
    e = _created(spark, d, "realm = 'research' AND domain = 'reading'", "id", "domain", "content").orderBy(_newest(), "id").limit(10)
    return e.select("id", "domain", F.substring("content", 1, 300).alias("snippet"))


@query(f"{TIMED} SELECT domain, id FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY us DESC NULLS LAST, id) AS k FROM tents WHERE realm LIKE 'agent%') WHERE k <= 5")
def layer_last_n(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("domain").orderBy(_newest(), "id"))
    return _created(spark, d, "startswith(realm, 'agent')", "id", "domain").withColumn("k", k).where("k <= 5").select("domain", "id")


@query(f"{TIMED} SELECT realm, string_agg(substr(content, 1, 200), chr(10) ORDER BY k) AS summary FROM (SELECT realm, content, row_number() OVER (PARTITION BY realm ORDER BY us DESC NULLS LAST, id) AS k FROM tents) WHERE k <= 10 GROUP BY realm")
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("realm").orderBy(_newest(), "id"))
    top = _created(spark, d, None, "id", "realm", "content").select("realm", F.substring("content", 1, 200).alias("c"), k.alias("k")).where("k <= 10 AND c IS NOT NULL")
    return top.groupBy("realm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda r: r["c"]), "\n").alias("summary"))


# Retrieval metrics: every vector whose id is divisible by 50 is a query, those of its label are relevant.

_RANKS = "r AS (SELECT a.vec_id AS q, (a.label = b.label)::INT AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


def _ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    from memloom.operators.search import batch_topk

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    hits = batch_topk(e, e.where("id % 50 = 0"), k)
    label = e.select("id", "label")
    q = label.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    return hits.join(label, "id").join(q, "query_id").select("query_id", "rank", (F.col("label") == F.col("want")).cast("int").alias("rel"))


@query(f"WITH {_RANKS} SELECT q AS query_id, max(rel) AS recall_any, min(rel) AS recall_all, round(sum(rel)::DOUBLE / 10, 6) AS precision_at_k FROM r WHERE rank <= 10 GROUP BY q")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d, 10).groupBy("query_id").agg(F.max("rel").alias("recall_any"), F.min("rel").alias("recall_all"), F.round(F.sum("rel").cast("double") / 10, 6).alias("precision_at_k"))


@query(f"WITH {_RANKS}, x AS (SELECT q, sum(rel / log2(rank + 1)) AS dcg, sum(rel)::BIGINT AS n FROM r WHERE rank <= 10 GROUP BY q) SELECT q AS query_id, round(CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, n + 1) t(i)) ELSE 0 END, 6) AS ndcg FROM x")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    s = _ranks(spark, d, 10).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("rel").cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return s.select("query_id", F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


_TURNS = """l AS (SELECT doc_id, i, line, regexp_extract(line, '^(User|Assistant): ', 1) AS role FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE source = 'chat_export' AND text IS NOT NULL))),
    n AS (SELECT *, sum((role <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS turn FROM l), t AS (SELECT doc_id, turn::BIGINT AS turn, max(role) AS role, string_agg(regexp_replace(line, '^(User|Assistant): ', ''), chr(10) ORDER BY i) AS message FROM n WHERE turn > 0 GROUP BY ALL)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of exported chats: (doc_id, turn, role, message). The window runs within one text."""
    pat = "^(User|Assistant): "
    chats = table(spark, d, "documents").where("source = 'chat_export'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    role = F.regexp_extract("line", pat, 1)
    n = chats.withColumn("role", role).withColumn("turn", F.sum((F.col("role") != "").cast("long")).over(Window.partitionBy("doc_id").orderBy("i"))).where("turn > 0")
    lines = F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("line", pat, "").alias("line"))))
    return n.groupBy("doc_id", "turn").agg(F.max("role").alias("role"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("message"))


@query(f"WITH {_TURNS} SELECT doc_id, turn, role, message FROM t")
def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("doc_id", "turn", "role", "message")


@query(f"WITH {_TURNS}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS k FROM t WHERE role = 'User') SELECT doc_id, count(*) FILTER (k <= 30) AS recent, string_agg(substr(message, 1, 80), ' | ' ORDER BY turn) FILTER (k <= 10) AS summary FROM u GROUP BY doc_id")
def checkpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("turn")))
    u = turns(spark, d).where("role = 'User'").withColumn("k", k)
    last = F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("turn", F.substring("message", 1, 80).alias("m")))))
    return u.groupBy("doc_id").agg(F.count_if(F.col("k") <= 30).alias("recent"), F.array_join(F.transform(last, lambda x: x["m"]), " | ").alias("summary"))


@query(f"{WITH}, r AS (SELECT id, realm, unnest(list_distinct(regexp_extract_all(content, 'ent_[0-9]+'))) AS ref FROM nods) SELECT r.id, round(count(e.id)::DOUBLE / count(*), 6) AS recall FROM r LEFT JOIN ents e ON e.id = r.ref AND e.realm = r.realm GROUP BY r.id")
def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    from memloom.sources.tables import nodes

    r = nodes(spark, d).select("id", "realm", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("ent_[0-9]+"), F.lit(0)))).alias("ref"))
    e = table(spark, d, "entities").select(F.col("id").alias("ref"), "realm").distinct().withColumn("hit", F.lit(1))
    return r.join(e, ["ref", "realm"], "left").groupBy("id").agg(F.round(F.count("hit").cast("double") / F.count(F.lit(1)), 6).alias("recall"))


@query()
def packed_nodes(spark: SparkSession, d: str) -> DataFrame:
    from memloom.sources.tables import nodes

    return nodes(spark, d).select("id", F.explode(T.packed_lines("content")).alias("c")).select("id", "c.i", "c.text")
