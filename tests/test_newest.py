"""The newest memories, with created_at in mixed notations, against brute force over the true times."""

from __future__ import annotations

import datetime
import random

import pytest

from memloom.plans import graph, relational, text

FORMS = ("%Y-%m-%dT%H:%M:%SZ", "%a, %d %b %Y %H:%M:%S +0000", "%d/%m/%Y %H:%M:%S", "%Y%m%dT%H%M%SZ", "%B %d, %Y %H:%M:%S")
UNKNOWN = ("yesterday", "unknown", "n/a", "TBD", None)
PLACES = (("work", "contacts"), ("research", "reading"), ("agent_a", "diary"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = random.Random(5)
    rows = []
    for k in range(2400):
        at = datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=r.randrange(10**8))
        form = None if k % 9 == 0 else FORMS[r.randrange(len(FORMS))]
        realm, domain = PLACES[0] if k < 2200 else PLACES[1 + k % 2]
        rows.append((f"e{k:04}", realm, domain, f"text {k}", at if form else None, at.strftime(form) if form else UNKNOWN[k % 5]))
    d = str(tmp_path_factory.mktemp("store"))
    e = [(i, realm, domain, c, '{"added_by": "x", "importance": "%d"}' % (int(i[1:]) * 7919 % 2400), "f", v) for i, realm, domain, c, _, v in rows]
    spark.createDataFrame(e, "id string, realm string, domain string, content string, metadata string, source_file string, created_at string").write.parquet(f"{d}/entities.parquet")
    spark.createDataFrame([("x", "UTC", "DMY")], "adapter_name string, tz string, date_order string").write.parquet(f"{d}/adapters.parquet")
    return d, sorted(rows, key=lambda x: (x[4] is None, -x[4].timestamp() if x[4] else 0, x[0]))


def test_layers(spark, store):
    d, rows = store
    of = lambda realm: [x for x in rows if x[1] == realm]
    importance = lambda x: int(x[0][1:]) * 7919 % 2400
    assert {r["id"] for r in text.l1_essential(spark, d).collect()} == {x[0] for x in sorted(of("work")[:2000], key=lambda x: (-importance(x), x[0]))[:15]}
    assert {r["id"] for r in text.recall_l2(spark, d).collect()} == {x[0] for x in of("research")[:10]}
    assert {r["id"] for r in text.layer_last_n(spark, d).collect()} == {x[0] for x in of("agent_a")[:5]}
    assert {r["realm"]: r["summary"] for r in text.layer_summary(spark, d).collect()} == {realm: "\n".join(x[3] for x in of(realm)[:10]) for realm, _ in PLACES}


def test_page_latest_and_dates(spark, store):
    d, rows = store
    assert [r["id"] for r in relational.list_entities_page(spark, d).collect()] == [x[0] for x in rows if x[1] == "work"][20:40]
    r = relational.memories_filed_away(spark, d).first()
    assert (r["total"], r["latest_id"]) == (2400, rows[0][0])
    want = {domain: ",".join(sorted({x[4].strftime("%Y-%m-%d") for x in rows if x[2] == domain and x[4]})[-5:]) for _, domain in PLACES}
    assert {r["domain"]: r["dates"] for r in graph.graph_nodes(spark, d).collect()} == want
