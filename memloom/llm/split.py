"""Oversized texts cut into pieces at natural boundaries, by recursive bisection.

A text longer than the limit is cut once, at the strongest boundary near its middle; each half that is still
too long for its room (the limit less the overlap) is cut again. Every piece but the first then gets the last
characters of the text before it as overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import table

LIMIT, OVERLAP = 2000, 100
#: Ends of paragraphs, lines, sentences and words, strongest first; a cut falls behind the match.
BOUNDARIES = tuple(map(re.compile, (r"\n[ \t]*\n\s*", r"\n", r"[.!?…][\"'”’)\]»]*\s+|[。！？]", r"\s+")))


def cut_at(text: str, lo: int, hi: int) -> int:
    """Where to cut ``text[lo:hi]``: behind the strongest kind of boundary in its middle half, nearest to the middle
    (ties: the earlier); if that has none, the same in the whole span; in the exact middle only where there is none at all."""
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    for first, last in ((max(lo, mid - reach), min(hi, mid + reach)), (lo, hi)):
        for kind in BOUNDARIES:
            ends = [m.end() for m in kind.finditer(text, first, last) if lo < m.end() < hi]
            if ends:
                return min(ends, key=lambda e: (abs(e - mid), e))
    return mid


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces with their overlap, in order. A text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    cores, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit - overlap:
            cores.append((lo, hi))
        else:
            cut = cut_at(text, lo, hi)
            todo += [(cut, hi), (lo, cut)]
    return [(max(0, lo - overlap) if lo else 0, hi) for lo, hi in cores]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, i, k, n, lo, hi, x[lo:hi]) for t, i, x in zip(*(b.column(c).to_pylist() for c in ("tbl", "id", "text")), strict=True) for s in [spans(x, limit, overlap)] for n in [len(s)] for k, (lo, hi) in enumerate(s)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["tbl", "id", "piece", "pieces", "starts", "ends", "text"])

    return run


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts above ``limit`` characters (code points): (tbl, id, piece, pieces, starts, ends, text).

    ``df``: tbl, id, text; other columns are ignored. No piece has more than ``limit`` characters; leaving out each
    piece's overlap and joining the rest gives the text back. Null, empty and shorter texts give no rows. A row
    delivered twice gives its pieces twice; callers that need them once keep distinct rows.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half the limit")
    long = df.select("tbl", "id", "text").where(F.length("text") > limit)
    return long.mapInArrow(_pieces(limit, overlap), "tbl string, id string, piece int, pieces int, starts int, ends int, text string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of entities and nodes: (tbl, id, text)."""
    one = lambda t: table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "id", F.col("content").alias("text"))
    return one("entities").unionByName(one("nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose content was cut."""
    return pieces(texts(spark, sf_dir)).where("pieces > 1").select("tbl", "id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces."""
    return pieces(texts(spark, sf_dir)).distinct()
