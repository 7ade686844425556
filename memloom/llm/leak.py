"""Held-out texts in a corpus, by Wu-Manber multi-pattern search over words.

Patterns are all runs of ``RUN`` words of the held-out items, the alphabet is the words. A window of RUN words slides over each
document; the shift table tells from its last two words how far it can move without missing a pattern. Where it can't move, a bit
table of whole runs tells most chance meetings apart, and what is left goes to the bucket of its suffix, where the passage is
compared with the patterns as text.

The shift and bit tables are made by Spark and have a fixed greatest size whatever the number of items; beyond it they let more
candidates through, which the comparison sorts out. The patterns themselves stay distributed. The corpus is read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.words import word_hashes, words
from memloom.llm.arrays import flat, mixed
from memloom.session import table, written

RUN, BLOCK = 15, 2
#: Greatest sizes of the tables that every task holds: 2^20 cells of a byte and 2^26 bits.
CELL_BITS, FILTER_BITS = 20, 26

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))


def _blocks(w: np.ndarray, bits: int) -> np.ndarray:
    """Cell of the two words that end at each position (the first has none and gets cell 0)."""
    w = w.view(np.uint64)
    out = np.zeros(len(w), np.int64)
    out[1:] = (mixed(w[:-1] * np.uint64(3) + w[1:]) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def _runs(w: np.ndarray, ends: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the runs of ``run`` words that end at the positions ``ends``."""
    with np.errstate(over="ignore"):
        powers = np.full(len(w), _ODD)
        powers[:1] = 1
        inverse = np.full(len(w), _INVERSE)
        inverse[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(w.view(np.uint64)) * np.cumprod(powers))])
        return mixed((sums[ends + 1] - sums[ends + 1 - run]) * np.cumprod(inverse)[ends + 1 - run])


def _cells(run: int, cell_bits: int, filter_bits: int):
    """Least shift of every cell (kind 0) and the set words of the bit table (kind 1) for the items of a task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.full(1 << cell_bits, run - BLOCK + 1, np.int64)
        bits = np.zeros(1 << max(0, filter_bits - 6), np.uint64)
        for b in batches:
            w, offsets = flat(b.column("w"))
            block = _blocks(w, cell_bits)
            at = np.arange(len(w)) - np.repeat(offsets[:-1], np.diff(offsets))
            left = np.repeat(offsets[1:], np.diff(offsets)) - 1 - np.arange(len(w))
            # The block that ends at word ``at`` stands in patterns that end up to min(left, run - BLOCK) words later, none before word run - 1.
            inside = at >= BLOCK - 1
            by = np.maximum(0, run - 1 - at)
            fits = inside & (by <= np.minimum(left, run - BLOCK))
            np.minimum.at(shift, block[fits], by[fits])
            ends = np.flatnonzero(at >= run - 1)
            k = _runs(w, ends, run) >> np.uint64(64 - filter_bits)
            np.bitwise_or.at(bits, (k >> np.uint64(6)).astype(np.int64), np.uint64(1) << (k & np.uint64(63)))
        cell, word = np.flatnonzero(shift < run - BLOCK + 1), np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(cell), len(word)]).astype(np.int32)), pa.array(np.concatenate([cell, word])), pa.array(np.concatenate([shift[cell], bits[word].view(np.int64)]))], ["kind", "at", "v"]
        )

    return made


def _search(tables, run: int, cell_bits: int, filter_bits: int):
    """(doc_id, text, ends): the documents in which runs may stand, and the words (from 0) at which these end."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, bits = tables.value
        for b in batches:
            w, offsets = flat(b.column("w"))
            move = shift[_blocks(w, cell_bits)].tolist()
            stop: list[int] = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at = lo + run - 1
                while at < hi:
                    by = move[at]
                    if by:
                        at += by
                    else:
                        stop.append(at)
                        at += 1
            ends = np.array(stop, np.int64)
            k = _runs(w, ends, run) >> np.uint64(64 - filter_bits) if len(ends) else np.empty(0, np.uint64)
            ends = ends[(bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)]
            row = np.searchsorted(offsets, ends, "right") - 1
            rows, first = np.unique(row, return_index=True)
            own = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array((ends - offsets[row]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), b.column("text").take(pa.array(rows)), own], ["doc_id", "text", "ends"])

    return found


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, cell_bits: int = CELL_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id): the document and the item share at least ``run`` consecutive words.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored. Null and empty texts and texts of
    fewer than ``run`` words share nothing. Repeated rows give one row. ``cell_bits`` and ``filter_bits`` bound the
    tables that every task holds; they change the work, never the result.
    """
    spark = docs.sparkSession
    ready = written(items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") >= run)).distinct())
    n = ready.agg(F.sum(F.size("words"))).first()[0] or 0
    cell_bits, filter_bits = (max(8, min(most, (each * n).bit_length())) for most, each in ((cell_bits, 4), (filter_bits, 32)))
    parts = ready.select(F.transform("words", lambda x: F.xxhash64(x)).alias("w")).mapInArrow(_cells(run, cell_bits, filter_bits), "kind int, at long, v long")
    cells = parts.groupBy("kind", "at").agg(F.min("v").alias("least"), F.bit_or("v").alias("all")).toArrow()  # no more rows than cells and words of the bit table
    kind, at = (cells[c].to_numpy() for c in ("kind", "at"))
    shift, bits = np.full(1 << cell_bits, run - BLOCK + 1, np.uint8), np.zeros(1 << (filter_bits - 6), np.uint64)
    shift[at[kind == 0]] = cells["least"].to_numpy()[kind == 0]
    bits[at[kind == 1]] = cells["all"].to_numpy()[kind == 1].view(np.uint64)
    tables = spark.sparkContext.broadcast((shift, bits))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= run)
    met = base.mapInArrow(_search(tables, run, cell_bits, filter_bits), "doc_id long, text string, ends array<int>")
    # Bucket of the suffix, then the passage itself.
    passage = lambda w, end: F.slice(w, end - (run - 2), F.lit(run))
    bucket = lambda w: F.xxhash64(F.slice(w, run - BLOCK + 1, BLOCK))
    met = met.withColumn("words", words(F.col("text"))).select("doc_id", F.explode(F.transform("ends", lambda e: passage(F.col("words"), e))).alias("run"))
    patterns = ready.select("item_id", F.explode(F.transform(F.sequence(F.lit(run - 1), F.size("words") - 1), lambda e: passage(F.col("words"), e))).alias("run"))
    met, patterns = (x.select("*", bucket(F.col("run")).alias("suffix")).distinct() for x in (met, patterns))
    return met.join(patterns, ["suffix", "run"]).select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every held-out item that leaked: its kind and the number of documents that hold a passage of it."""
    n = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return n.join(table(spark, sf_dir, "eval_items").select("item_id", "kind"), "item_id").select("item_id", "kind", "documents")
