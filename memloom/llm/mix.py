"""Sources mixed to target shares by hash thresholds.

Tokens are summed by source and hash bucket. The budget of a source is met by whole repeats of all its documents
and a part chosen by hash: all buckets below a boundary bucket are in, and only the boundary bucket is looked
into again, bit by bit finer, until the threshold within it is found. Documents are then filtered by threshold;
nothing is sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import table, written

BITS, LEVELS = 10, 5  # 1,024 buckets at each of five levels
VOCABULARY = os.environ.get("MEMLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the public vocabulary's authors split text before merging bytes (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(vocabulary: str = VOCABULARY):
    """A pandas UDF that counts the tokens of texts; the vocabulary file is loaded once in each worker."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def digit(level: int):
    """The bucket at a level: the next ``BITS`` bits of ``h``, first the highest."""
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, budgets: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each source (whole, prefix): all documents are taken ``whole`` times, and once more those whose top
    BITS * LEVELS hash bits are below ``prefix``. The tokens reached don't exceed the budget.

    ``sized``: source, h, tokens. ``budgets``: tokens wanted from each source. The driver sees one histogram of at
    most 1,024 buckets a source and level.
    """
    spark = sized.sparkSession
    total = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    state = {s: [budgets[s] // n, budgets[s] % n, 0] for s, n in total.items() if n and s in budgets}
    for level in range(LEVELS):
        if not state:
            break
        edge = spark.createDataFrame([(s, v[2]) for s, v in state.items()], "source string, prefix long")
        near = sized.join(F.broadcast(edge), "source")  # a row for each source of the target table
        if level:
            near = near.where(F.shiftrightunsigned("h", 64 - BITS * level) == F.col("prefix"))
        histogram: dict[str, list[tuple[int, int]]] = {}
        for r in near.groupBy("source", digit(level).alias("b")).agg(F.sum("tokens").alias("n")).collect():
            histogram.setdefault(r["source"], []).append((r["b"], r["n"]))
        for s, v in state.items():
            left, bucket = v[1], 1 << BITS
            for b, n in sorted(histogram.get(s, [])):
                if n > left:
                    bucket = b
                    break
                left -= n
            v[1] = left
            v[2] = (v[2] << BITS) + min(bucket, (1 << BITS) - 1)
    return {s: (int(v[0]), int(v[2])) for s, v in state.items()}


def sized_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, h, tokens) of the documents, written once."""
    return written(docs.select("doc_id", "source", F.xxhash64("doc_id", "source").alias("h"), token_counts(vocabulary)("text").alias("tokens")))


def budgets(sized: DataFrame, targets: DataFrame, size: int | None = None) -> tuple[dict[str, int], dict[str, tuple[float, int]]]:
    """Tokens for each source, and the targets (share, most repeats). Without ``size`` the mix is as large as the
    caps on repeats allow. Shares are taken relative to their sum; sources without documents get none and leave
    the other shares as they are."""
    wanted = {r["source"]: (float(r["target_share"]), max(0, int(r["max_repeats"]))) for r in targets.collect() if r["source"] is not None and r["target_share"] and r["target_share"] > 0 and r["max_repeats"]}
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect() if r["n"]}
    whole = sum(s for s, _ in wanted.values()) or 1.0
    wanted = {k: (s / whole, m) for k, (s, m) in wanted.items()}
    usable = {k: v for k, v in wanted.items() if k in have}
    most = min((have[k] * m / s for k, (s, m) in usable.items()), default=0)
    size = most if size is None else size
    return {k: int(min(size * s, have[k] * m)) for k, (s, m) in usable.items()}, wanted


def mixed(docs: DataFrame, targets: DataFrame, size: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, tokens, repeats) and the report (source, target_share, actual_share, tokens,
    documents, most_repeats).

    Documents with a null source or one without target are left out; null and empty texts have no tokens and are
    left out. No document is taken more than ``max_repeats`` times. A source whose documents don't suffice for
    its share of a given ``size`` is taken as often as allowed, and the report shows what it reached. Empty tables
    give an empty selection. Each target source must be given once.
    """
    spark = docs.sparkSession
    names = [r["source"] for r in targets.select("source").distinct().collect() if r["source"] is not None]
    sized = sized_documents(docs.where(F.col("source").isin(names)), vocabulary).where("tokens > 0")
    wanted, targets_of = budgets(sized, targets, size)
    cut = thresholds(sized, wanted)
    plan = spark.createDataFrame([(s, w, p) for s, (w, p) in cut.items()], "source string, whole int, prefix long")
    top = F.shiftrightunsigned("h", 64 - BITS * LEVELS)
    chosen = sized.join(F.broadcast(plan), "source").withColumn("repeats", F.col("whole") + (top < F.col("prefix")).cast("int")).where("repeats > 0")
    selection = chosen.select("doc_id", "source", "tokens", "repeats")
    per = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = spark.createDataFrame([(s, share) for s, (share, _) in targets_of.items()], "source string, target_share double")
    all_tokens = per.agg(F.sum("tokens").alias("all_tokens"))
    report = goal.join(per, "source", "left").join(F.broadcast(all_tokens))  # one row
    report = report.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return selection, report


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen, with how often each is taken."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
