"""Noise in transcripts, and words beyond the first 3,000 characters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.plans import text as P

CASES = [
    ("a\n<system-reminder>\nhidden\n</system-reminder>\nb", "a\nb"),
    ("> <hook_output x=1>y</hook_output>\nb", "b"),
    ("a <system-reminder>quoted</system-reminder> b", "a <system-reminder>quoted</system-reminder> b"),
    ("<command-name>open\n\nnext message</command-name>", "<command-name>open\n\nnext message</command-name>"),
    ("a\nCURRENT TIME: 12:00\n> Ran 2 Stop hooks (1 s)\n… +12 lines\nb [3 tokens] (ctrl+o to expand)", "a\nb"),
    ("it was CURRENT TIME: now (ctrl+o to expand)", "it was CURRENT TIME: now (ctrl+o to expand)"),
    ("a\n\n\n\n\nb", "a\n\n\nb"),
    ("<tool>kept</tool>", "<tool>kept</tool>"),
]


@pytest.mark.parametrize(("text", "want"), [*CASES, (None, None), ("", "")])
def test_noise_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.without_noise(F.col("t")).alias("t")).first()["t"] == want


def test_long_blocks(spark):
    """A block of 100,000 lines is stripped like a short one."""
    long = "a\n<hook_output>" + "line <b>\n" * 100_000 + "</hook_output>\nb"
    assert spark.createDataFrame([(long,)], "t string").select(T.without_noise(F.col("t")).alias("t")).first()["t"] == "a\nb"


def test_texts_with_noise_stay(spark, tmp_path):
    rows = [(f"e{k}", t, "r", "d", None, "f", None) for k, (t, _) in enumerate(CASES)]
    spark.createDataFrame(rows, "id string, content string, realm string, domain string, metadata string, source_file string, created_at string").write.parquet(f"{tmp_path}/entities.parquet")
    assert {r["id"]: r["content"] for r in P.strip_noise(spark, str(tmp_path)).collect()} == {f"e{k}": w for k, (_, w) in enumerate(CASES)}


def test_topic_reads_the_whole_text(spark):
    df = spark.createDataFrame([("x " * 2000 + "a backlog with a deadline",)], "t string")
    assert df.select(T.topic(F.col("t")).alias("t")).first()["t"] == "planning"
