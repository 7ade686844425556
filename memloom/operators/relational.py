"""Scans, metadata predicates, counts and changes of the memory tables."""

from __future__ import annotations

import fnmatch
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.tables import meta

_OPS = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def where(tree: dict[str, Any], null_mode: str = "python") -> Column:
    """A metadata predicate tree as a Column.

    Keys stand for equality or hold an operator ($eq $ne $in $nin $gt $gte $lt $lte); ``$and`` and ``$or`` hold lists
    of trees; several keys are joined by and. Numbers compare as numbers, all else as text; a value that can't be
    read as a number fails. On a missing key $ne and $nin hold under ``null_mode`` python and fail under sql; all
    other operators fail.
    """
    parts: list[Column] = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [where(t, null_mode) for t in value]))
            continue
        for op, v in (value if isinstance(value, dict) else {"$eq": value}).items():
            values = v if op in ("$in", "$nin") else [v]
            number = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values)
            have = meta(key).try_cast("double") if number else meta(key)
            want = [float(x) if number else str(x).lower() if isinstance(x, bool) else x for x in values]
            if op in ("$in", "$nin"):
                test = have.isin(want) if op == "$in" else ~have.isin(want)
            else:
                test = getattr(have, _OPS[op])(F.lit(want[0]))
            missing = F.lit(null_mode == "python" and op in ("$ne", "$nin"))
            parts.append(F.coalesce(test, missing))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contains(text: Column, part: str) -> Column:
    """Substring without regard to case; ``%`` and ``_`` in ``part`` are wildcards."""
    return text.ilike(f"%{part}%")


def globbed(text: Column, patterns: list[str]) -> Column:
    """Whether the whole text matches one of the shell patterns."""
    return reduce(lambda a, b: a | b, [text.rlike("^" + fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace("\\Z", "").replace("\\z", "") + "$") for p in patterns])


def valid_name(name: Column) -> Column:
    """Names of realms and domains: 1 to 128 letters, digits, blanks, ``_ . ' -``, no path parts."""
    n = F.trim(name)
    return F.coalesce(n.rlike(r"^[\p{L}\p{N}]([\p{L}\p{N}_ .'-]{0,126}[\p{L}\p{N}])?$") & ~n.contains(".."), F.lit(False))


def page(df: DataFrame, limit: int, offset: int = 0, **equal: str) -> DataFrame:
    """A page of a filtered scan, newest first by ``us`` (``timestamps.created``), unknown times last."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df.orderBy(F.col("us").desc_nulls_last(), "id").offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` put in place of or beside its rows; of several new rows for a key the last by
    ``seq`` counts. Rows of ``new`` with blank content are skipped."""
    new = new.where(F.length(F.trim("content")) > 0)
    last = new.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).where("_rank = 1").drop("_rank", "seq")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def add_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it doesn't have."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``df`` without the rows whose key is in ``gone``."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def merged_metadata(metadata: Column, new: dict[str, Column]) -> Column:
    """The JSON object ``metadata`` as a map of texts, with the values ``new`` put over it key by key; null counts as empty."""
    old = F.coalesce(F.from_json(metadata, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    keys = list(new)
    kept = F.map_filter(old, lambda k, v: ~k.isin(keys))
    return F.map_concat(kept, F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v.cast("string")))))


def is_registry(key: Column) -> Column:
    """Rows that only mark a source as mined."""
    return F.coalesce(meta("ingest_mode") == "registry", F.lit(False)) | F.coalesce(meta("domain") == "_registry", F.lit(False)) | key.startswith("_reg_")
