"""The tables of the memory store, one row per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.session import table


def keep_one(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls count as empty text)."""
    w = Window.partitionBy(key).orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def entities(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """``where`` may use what doesn't differ between deliveries of an id (realm, domain, content, source_file): it is
    applied first, so it reaches the scan."""
    e = table(spark, sf_dir, "entities")
    return keep_one(e if where is None else e.where(where), "id", "metadata", "created_at")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_one(table(spark, sf_dir, "nodes"), "id", "metadata", "created_at")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_one(table(spark, sf_dir, "facts"), "id", "created_at", "valid_to")


def meta(key: str) -> Column:
    """A value of the JSON metadata as text; null where absent."""
    return F.get_json_object("metadata", f"$.{key}")


_ONE = "SELECT * EXCLUDE (_rank) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {}) AS _rank FROM {}) WHERE _rank = 1"
_BY = "coalesce(metadata, '') DESC, coalesce(created_at, '') DESC"
#: The same as SQL, to open a WITH clause.
WITH = f"WITH ents AS ({_ONE.format(_BY, 'entities')}), nods AS ({_ONE.format(_BY, 'nodes')}), fcts AS ({_ONE.format("coalesce(created_at, '') DESC, coalesce(valid_to, '') DESC", 'facts')})"


def meta_sql(key: str) -> str:
    return f"json_extract_string(metadata, '$.{key}')"
