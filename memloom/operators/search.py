"""Vector, keyword and hybrid search.

A keyword query counts its terms inside each row, so only one row of statistics and the hits are moved; tokens are
never shuffled. Filters come before the top k. Every ranking ends with the id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import written

TOKEN = r"[\p{L}\p{N}_]{2,}"
TIERS = [0.40, 0.25, 0.15, 0.08, 0.04]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_stats(df: DataFrame, terms: list[str], text: str = "content", prefix: bool = False) -> DataFrame:
    """``df`` without its text and with ``dl`` and a count ``tf_i`` for each term, one row for equal other columns: texts
    are read once and only numbers are moved."""
    t = df.withColumn("_tok", tokens(F.coalesce(F.col(text), F.lit(""))))
    hit = lambda q: (lambda x: F.startswith(x, F.lit(q))) if prefix else (lambda x: x == q)
    keys = [c for c in df.columns if c != text]
    t = t.select(*keys, F.size("_tok").alias("dl"), *(F.size(F.filter("_tok", hit(q))).alias(f"tf_{i}") for i, q in enumerate(terms)))
    return t.groupBy(*keys).agg(*(F.max(c).alias(c) for c in t.columns if c not in keys))


def corpus_stats(t: DataFrame, terms: list[str]) -> DataFrame:
    """One row of statistics (n, avgdl, df_i)."""
    return t.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf_{i}") > 0).cast("double")).alias(f"df_{i}") for i in range(len(terms))))


def bm25(df: DataFrame, terms: list[str], text: str = "content", k1: float = 1.5, b: float = 0.75, few: bool = False) -> DataFrame:
    """``df`` without its text and with ``bm25`` over its own rows as the corpus; query terms count once, an empty corpus
    scores 0. Rows that are equal but for the text count once. ``few``: ``df`` is a top k, not worth writing its counts."""
    terms = sorted(set(terms))
    t = term_stats(df, terms, text)
    keys = [c for c in df.columns if c != text]
    t = t if few else written(t)  # read for the statistics and for the scores
    t = t.join(F.broadcast(corpus_stats(t, terms)))  # one row
    part = lambda i: F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5) + 1.0) * F.col(f"tf_{i}") * (k1 + 1) / (F.col(f"tf_{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = reduce(lambda x, y: x + y, [F.when(F.col(f"tf_{i}") > 0, part(i)).otherwise(0.0) for i in range(len(terms))], F.lit(0.0))
    return t.select(*keys, F.round(score, 6).alias("bm25"))


def fts_terms(query: str) -> list[str]:
    """Prefixes that all must match, of a query in words: split at blanks and hyphens. A query that uses operators or quotation
    marks is no list of words and is refused."""
    words = query.split()
    if any(w.upper() in ("AND", "OR", "NOT") or w.upper().startswith("NEAR") or w.startswith('"') for w in words):
        raise ValueError("write operators and phrases as predicates")
    return [x.lower().rstrip("*") for w in words for x in w.split("-") if x]


def prefix_match(df: DataFrame, prefixes: list[str], n: int, text: str = "content", within: Column | None = None) -> DataFrame:
    """The ``n`` best rows that hold a token for every prefix: (id, score), the inverse document frequency floored
    at a millionth, k1 1.2, b 0.75. Rows that are equal but for the text count once. ``within``: a condition on other columns that
    the rows given must meet; the statistics are those of all rows."""
    t = written(term_stats(df, prefixes, text, prefix=True))  # read for the statistics and for the hits
    stats = corpus_stats(t, prefixes)
    t = t if within is None else t.where(within)
    t = t.where(reduce(lambda x, y: x & y, [F.col(f"tf_{i}") > 0 for i in range(len(prefixes))])).join(F.broadcast(stats))  # one row
    part = lambda i: F.greatest(F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(1e-6)) * F.col(f"tf_{i}") * 2.2 / (F.col(f"tf_{i}") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    score = F.round(reduce(lambda x, y: x + y, [part(i) for i in range(len(prefixes))]), 6)
    return t.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(n)


def overlap(words: list[str], text: Column) -> Column:
    """Share of the words that are substrings of the lower-cased text; 0 for no words."""
    if not words:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("double") for w in words]) / len(words)


def quoted(query: str) -> list[str]:
    """Phrases in quotes of at least three characters."""
    return [a or b for a, b in re.findall(r'"([^"]{3,})"|(?<!\w)\'([^\']{3,})\'(?!\w)', query)]


def usable(v: Column, dim: int) -> Column:
    """Vectors of ``dim`` numbers without null or NaN and not zero."""
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, query: list[float]) -> Column:
    """Cosine, rounded to six digits."""
    norm = float(np.sqrt(sum(x * x for x in query))) or 1.0
    return F.round(dot(v, F.array(*(F.lit(float(x)) for x in query))) / (F.sqrt(dot(v, v)) * norm), 6)


def vector_topk(df: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id") -> DataFrame:
    """The ``k`` rows of highest cosine: (id, similarity)."""
    return df.where(usable(F.col(vector), len(query))).select(F.col(key).alias("id"), similarity(F.col(vector), query).alias("similarity")).distinct().orderBy(F.desc("similarity"), "id").limit(k)


def batch_topk(data: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` rows of highest cosine for every query but the query itself.

    Both tables: id BIGINT, vector. The stated queries are taken ``block`` at a time; each block is a matrix that
    every task multiplies its rows with, keeping its own best k a query before anything is shuffled.
    """
    sets = max(1, -(-queries.count() // block))
    out = None
    for s in range(sets):
        own = queries if sets == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == s)
        rows = own.select("id", "vector").toPandas().sort_values("id")
        if rows.empty:
            continue
        ids, q = rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(parts: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for p in parts:
                x = np.stack(p["vector"].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim = np.round(q @ x.T, 6)
                sim[ids[:, None] == p["id"].to_numpy()[None, :]] = -2
                order = np.lexsort((np.broadcast_to(p["id"].to_numpy(), sim.shape), -sim), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": p["id"].to_numpy()[order].ravel(), "similarity": np.take_along_axis(sim, order, 1).ravel()}).query("similarity > -2")

        found = data.select("id", "vector").mapInPandas(best, "query_id long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def node_boosts(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, boost) of the hits (id, source_file) whose source file has nodes: by number of nodes .40, .25, .15, .08,
    then .04; ties go by id."""
    n = nodes.where("source_file <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("nodes"))
    joined = hits.join(n, "source_file")
    rank = F.row_number().over(Window.orderBy(F.desc("nodes"), "id"))  # over the hits, a top k
    return joined.select("id", "nodes", F.element_at(F.array(*map(F.lit, TIERS)), F.least(rank, F.lit(len(TIERS)))).alias("boost"))


def hybrid(vec: DataFrame, kw: DataFrame, sources: Callable[[DataFrame], DataFrame], nodes: DataFrame, n: int) -> DataFrame:
    """Vector and keyword hits in one ranking: keyword scores are divided by their maximum, a vector hit stands for
    an id that both have, node boosts are added: (id, score, boost). ``sources`` adds source_file to hits (id)."""
    top = F.max("score").over(Window.partitionBy())  # over the hits, a top k
    k = kw.select("id", F.round(F.col("score") / top, 6).alias("score")).join(vec, "id", "left_anti")
    hits = vec.select("id", F.col("similarity").alias("score")).unionByName(k)
    named = sources(hits.select("id"))
    boosts = node_boosts(named, nodes).select("id", "boost")
    total = F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)
    return hits.join(boosts, "id", "left").select("id", total.alias("score"), F.coalesce("boost", F.lit(0.0)).alias("boost")).orderBy(F.desc("score"), "id").limit(n)


def hybrid_rank(hits: DataFrame, terms: list[str], n: int, vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """Hits (id, distance, content) ranked by weighted similarity and BM25 among the hits; a null distance counts as no
    similarity."""
    s = bm25(hits, terms, few=True)
    most = F.max("bm25").over(Window.partitionBy())  # over the hits, a top k
    near = F.greatest(F.lit(0.0), 1.0 - F.coalesce("distance", F.lit(1.0)))
    score = vector_weight * near + keyword_weight * F.when(most > 0, F.col("bm25") / most).otherwise(0.0)
    return s.select("id", F.round("bm25", 3).alias("bm25_score"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def with_neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Text of each hit's source within ``radius`` chunks of it, in order: (id, expanded, total).

    ``hits``: id, source_file, chunk_index; ``chunks``: the same and content."""
    total = chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("total"))
    near = hits.select("id", "source_file", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    text = near.join(chunks.select("source_file", "chunk_index", F.col("id").alias("of"), "content"), ["source_file", "chunk_index"])
    text = text.groupBy("id", "source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "of", "content"))), lambda r: r["content"]), "\n\n").alias("expanded"))
    return text.join(total, "source_file").select("id", "expanded", "total")


def sanitized(query: str, most: int = 250) -> str:
    """A query freed of surrounding prompt text: short queries pass; else the last question, else the last sentence of
    sensible length, else the tail."""
    q = query.strip()
    if len(q) <= 200:
        return q
    asked = [s.strip() for s in re.split(r"(?<=[.!?？。])\s+|\n+", q) if s.strip()]
    for s in reversed(asked):
        if s.endswith(("?", "？")) and len(s) >= 10:
            return s[-most:]
    for s in reversed(asked):
        if len(s) >= 10:
            return s[-most:]
    return q[-most:]


def tfidf(df: DataFrame, least: int = 2, most: float = 0.85, vocabulary: int = 32_768) -> DataFrame:
    """(id, term, weight) of every row's terms: term frequency by length times ln((n + 1) / (df + 1)) + 1, over terms in
    at least ``least`` rows and at most the share ``most`` of them, the ``vocabulary`` most frequent. ``df``: id, content;
    ids are unique. The vocabulary is bounded, so it is broadcast."""
    n = df.count()
    t = df.withColumn("tok", tokens(F.coalesce("content", F.lit(""))))
    t = t.select("id", F.size("tok").alias("dl"), F.explode("tok").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("c"))
    v = t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least) & (F.col("df") <= most * n)).orderBy(F.desc("df"), "term").limit(vocabulary)
    weight = F.col("c").cast("double") / F.col("dl") * (F.log((n + 1.0) / (F.col("df") + 1)) + 1)
    return t.join(F.broadcast(v), "term").select("id", "term", F.round(weight, 6).alias("weight"))
