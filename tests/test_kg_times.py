"""Periods in mixed notations, against times worked out by hand."""

from __future__ import annotations

from memloom.operators import kg as K
from memloom.plans import kg as P

# id, adapter, valid_from, valid_to, and what they mean (None: open)
FACTS = [
    (1, "dmy", "01/02/2024", "3 March 2024", "2024-02-01", "2024-03-03"),
    (2, "mdy", "01/02/2024", "Mar 3, 2024", "2024-01-02", "2024-03-03"),
    (3, "dmy", "2024-05-06 07:08:09 +02:00", None, "2024-05-06T05:08:09Z", None),
    (4, "dmy", "20240101", "2024-06-15T00:00:00.5Z", "2024-01-01", "2024-06-15T00:00:00.500000Z"),
    (5, "dmy", None, "TBD", None, None),
    (6, "dmy", "2024-06-16", "2024-06-20T00:00:00Z", "2024-06-16", "2024-06-20T00:00:00Z"),
    (7, "mdy", "1718409600", "12/31/2030", "2024-06-15T00:00:00Z", "2030-12-31"),
]


def facts(spark):
    rows = [(i, "s", "has_status", "o", f, t, 1.0, by) for i, by, f, t, _, _ in FACTS]
    f = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, adapter_name string")
    a = spark.createDataFrame([("dmy", "UTC", "DMY"), ("mdy", "UTC", "MDY")], "adapter_name string, tz string, date_order string")
    return P.timed(f, a)


def test_every_notation_is_read(spark):
    assert {(r["id"], r["valid_from"], r["valid_to"]) for r in facts(spark).collect()} == {(i, f, t) for i, _, _, _, f, t in FACTS}


def test_ended_facts_are_not_current(spark):
    g = facts(spark)
    assert {r["id"] for r in g.where(K.as_of("2024-06-15")).collect()} == {3, 4, 5, 7}
    assert {r["id"] for r in K.about(g, "s").where("current").collect()} == {3, 5}
    closed = {r["id"]: r["valid_to"] for r in K.invalidate(g, K.F.lit(True), "2024-06-15").collect()}
    assert closed == {i: t or "2024-06-15" for i, _, _, _, _, t in FACTS}


def test_latest_of_new_rows_by_time(spark):
    old = spark.createDataFrame([], "id long, subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    new = facts(spark).drop("id")
    r = K.upsert_triples(old, new).first()
    assert (r["valid_from"], r["valid_to"]) == ("2024-06-16", "2024-06-20T00:00:00Z")


def test_stats_over_tables(spark, tmp_path):
    rows = [(i, "s", "has_status", "o", f, t, 1.0, by, None, None) for i, by, f, t, _, _ in FACTS]
    schema = "id long, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, adapter_name string, source_entity_id string, created_at string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/facts.parquet")
    spark.createDataFrame([("dmy", "UTC", "DMY"), ("mdy", "UTC", "MDY")], "adapter_name string, tz string, date_order string").write.parquet(f"{tmp_path}/adapters.parquet")
    r = P.kg_stats(spark, str(tmp_path)).first()
    assert (r["total"], r["current"], r["expired"]) == (7, 2, 5)
    c = P.kg_entity_card(spark, str(tmp_path)).where("name = 's'").first()
    assert (c["first_seen"], c["last_seen"]) == ("2024-01-01", "2024-06-16")
