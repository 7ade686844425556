"""Small cases with results worked out by hand."""

from __future__ import annotations

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import graph as G
from memloom.operators import kg as K
from memloom.operators import relational as R
from memloom.operators import search as S
from memloom.sources import files as FS
from memloom.streaming import sweep as W


@pytest.mark.parametrize(
    ("tree", "python", "sql"),
    [({"k": 1}, {"a"}, {"a"}), ({"k": {"$ne": 1}}, {"b", "c"}, {"b"}), ({"k": {"$nin": [1, 2]}}, {"c"}, set()), ({"k": {"$in": [1, 2]}}, {"a", "b"}, {"a", "b"}), ({"k": {"$gte": 2}}, {"b"}, {"b"}), ({"k": {"$lt": 2}}, {"a"}, {"a"}), ({"$or": [{"k": 1}, {"j": "x"}]}, {"a", "c"}, {"a", "c"}), ({"$and": [{"k": {"$gt": 0}}, {"k": {"$lte": 1}}]}, {"a"}, {"a"})],
)
def test_where_trees(spark, tree, python, sql):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("b", '{"k": 2}'), ("c", '{"j": "x"}')], "id string, metadata string")
    for mode, want in (("python", python), ("sql", sql)):
        assert {r["id"] for r in df.where(R.where(tree, mode)).collect()} == want


def test_bm25_of_nothing(spark):
    df = spark.createDataFrame([("a", ""), ("b", None)], "id string, content string")
    assert {r["bm25"] for r in S.bm25(df, ["x"]).collect()} == {0.0}
    df = spark.createDataFrame([("a", "Ledger ledger of"), ("b", "none here")], "id string, content string")
    got = {r["id"]: r["bm25"] for r in S.bm25(df, ["ledger", "ledger"]).collect()}
    idf, dl = math.log(1.5 / 1.5 + 1), 3 / 2.5
    assert got == {"a": round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * dl)), 6), "b": 0.0}


def test_boost_tiers(spark):
    hits = spark.createDataFrame([(f"e{k}", f"f{k}") for k in range(7)], "id string, source_file string")
    nodes = spark.createDataFrame([(f"f{k}",) for k in range(7) for _ in range(10 - k)], "source_file string")
    assert [r["boost"] for r in S.node_boosts(hits, nodes).orderBy("id").collect()] == [0.4, 0.25, 0.15, 0.08, 0.04, 0.04, 0.04]


def test_batch_topk_in_blocks(spark):
    rows = [(k, [math.cos(k / 10), math.sin(k / 10)]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    one, many = (sorted(map(tuple, S.batch_topk(df, df, 3, block).collect())) for block in (1000, 7))
    assert one == many and len(one) == 90 and all(abs(r[0] - r[1]) <= 3 for r in one)


def test_query_sanitizer():
    assert S.sanitized(" short ") == "short"
    long = "You are a helpful model. " * 20 + "Where is the blue ledger kept? " + "Thanks."
    assert S.sanitized(long) == "Where is the blue ledger kept?"


def test_as_of_boundaries(spark):
    rows = [("a", "2024-06-15", None), ("b", "2024-06-15T10:00:00Z", None), ("c", None, "2024-06-15"), ("d", None, "2024-06-14"), ("e", None, None)]
    df = spark.createDataFrame(rows, "id string, valid_from string, valid_to string")
    assert {r["id"] for r in df.where(K.as_of("2024-06-15T00:00:00Z")).collect()} == {"a", "c", "e"}


def test_chain_with_ring(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in K.resolved(df, 6).collect()}
    assert got["a"] == "c" and got["b"] == "c" and set(got) == {"a", "b", "x", "y"}


@pytest.mark.parametrize(("days", "want"), [(0.0, 1.0), (1.0, 0.367879), (100.0, 0.05), (-3.0, 1.0)])
def test_decay(spark, days, want):
    r = spark.range(1).select(F.round(G.decayed(F.lit(1.0), F.lit(1.0), F.lit(days)), 6).alias("s")).first()
    assert r["s"] == want


def test_link_ids_are_symmetric(spark):
    r = spark.range(1).select(G.link_id(F.lit("a/x"), F.lit("b/y")).alias("p"), G.link_id(F.lit("b/y"), F.lit("a/x")).alias("q")).first()
    assert r["p"] == r["q"] and len(r["p"]) == 16


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "e"), ("e", "f")], "a string, b string")
    assert {r["node"]: r["component"] for r in G.components(e).collect()} == {**dict.fromkeys("abcdef", "a"), "x": "x", "y": "x"}


def test_upsert_keeps_last_and_skips_blank(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content string")
    new = spark.createDataFrame([("a", "3", 1), ("a", "4", 2), ("c", " ", 1)], "id string, content string, seq int")
    assert {tuple(r) for r in R.upsert(old, new).collect()} == {("a", "4"), ("b", "2")}


def test_chunks(spark):
    df = spark.createDataFrame([("x" * 100,), ("short",), ("a" * 80,)], "t string")
    assert [len(r["c"]) for r in df.select(T.fixed_chunks(F.col("t"), 40, 30).alias("c")).collect()] == [3, 0, 2]
    assert T.paragraphs("a" * 60 + "\n\nb\n\n" + "c" * 60) == ["a" * 60 + "\n\nb", "c" * 60]
    assert max(map(len, T.paragraphs("x" * 5000))) == 2000
    assert T.exchanges("> a\nb\n> c\nd\ne\n> f") == ["> a\nb", "> c\nd e", "> f"]


def test_content_dates(spark):
    df = spark.createDataFrame([("n/2024-01-02.md", "x"), ("a.md", "date: 2023-05-06\n2020-01-01"), ("a.md", "on 2022-02-03"), (None, None)], "f string, t string")
    assert [r["d"] for r in df.select(T.content_date(F.col("f"), F.col("t")).alias("d")).collect()] == ["2024-01-02", "2023-05-06", "2022-02-03", None]


def test_comments_and_names():
    assert T.comments('def f():\n    """Doc."""\n    return 1  # one\n') == ["Doc.", "one"]
    assert [(e["name"], e["type"]) for e in T.entities_in("Near Lake Como the Project Atlas began on 2024-01-02")] == [("Como", "location"), ("Atlas", "project"), ("2024-01-02", "date")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "sub" / "b.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "sub" / "c.log").write_text("x")
    (tmp_path / "d.bin").write_text("x")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in FS.text_files(spark, str(tmp_path), rules=["*.log"]).collect()}
    assert got == {"a.md": "hello", "b.txt": "café"}


def test_transcripts(spark):
    agent = "\n".join([json.dumps({"type": "user", "sessionId": "s", "uuid": "1", "timestamp": "t1", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}), "broken", json.dumps({"type": "assistant", "sessionId": "s", "uuid": "2", "timestamp": "t2", "message": {"role": "assistant", "content": "yes"}})])
    tree = json.dumps({"id": "c", "mapping": {"r": {"parent": None, "children": ["m"]}, "m": {"parent": "r", "children": [], "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}}}})
    chat = json.dumps([{"user": "U1", "text": "one", "ts": "1"}, {"user": "U2", "text": "two", "ts": "2"}])
    df = spark.createDataFrame([("/x/a.jsonl", agent), ("/x/b.json", tree), ("/x/c.json", chat), ("/x/d.json", "no")], "path string, text string")
    m = FS.transcripts(df)
    assert {(r["session"], r["role"], r["content"]) for r in m.collect()} == {("s", "user", "hi"), ("s", "assistant", "yes"), ("c", "user", "q"), ("c.json", "user", "one"), ("c.json", "assistant", "two")}
    assert {r["session"]: r["text"] for r in FS.as_transcript(m).collect()}["s"] == "> hi\nyes\n"


def test_sweep_keeps_ties_and_replays_nothing(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "session long, id string, ts timestamp, role string"
    stored = spark.createDataFrame([(1, "a", at(5), "user")], schema)
    new = spark.createDataFrame([(1, "a", at(5), "user"), (1, "b", at(5), "user"), (1, "c", at(4), "user"), (2, "d", at(1), "user"), (2, "d", at(1), "user")], schema)
    assert {(r["id"], r["state"]) for r in W.classified(new, stored).collect()} == {("a", "present"), ("b", "added"), ("c", "skipped"), ("d", "added")}
    again = W.classified(new, stored.unionByName(new))
    assert again.where("state = 'added'").count() == 0
