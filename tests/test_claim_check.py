"""Claims in texts against facts, worked out by hand."""

from __future__ import annotations

from memloom.plans import kg as P


def test_claims_of_texts_against_all_facts(spark, tmp_path):
    texts = [
        ("a", "I heard that Maria is Atlas's owner. Atlas's lead is Bob."),
        ("b", "Shared_Memory_Hub is Atlas's owner, and Zoe is Atlas's owner too"),
        ("c", "Ledger covers the warm pipeline. Bob is Atlas's lead"),
        ("d", None),
    ]
    facts = [
        (9, "maria", "owner", "Atlas", "31/12/2023"),  # ended, in another notation
        (1, "Maria", "sponsor", "atlas", None),
        (2, "Maria", "Works On", "Atlas", "2024-06-15"),  # holds on the day itself
        (3, "maria", "left", "Atlas", "3 March 2024"),
        (4, "Bob", "lead", "Atlas", None),
        (5, "shared memory hub", "uses", "Atlas", "2030-01-01"),
        (6, "Zoe", "owner", "Borealis", None),
        (7, "ledger", "follows", "warm pipeline", None),
        (8, "maria", "sponsor", "Atlas", None),
    ]
    e = "id string, content string, realm string, domain string, metadata string, source_file string, created_at string"
    spark.createDataFrame([(*t, "r", "d", None, "f", None) for t in texts], e).write.parquet(f"{tmp_path}/entities.parquet")
    f = "id long, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, adapter_name string, source_entity_id string, created_at string"
    spark.createDataFrame([(*x[:4], None, x[4], 1.0, "x", None, None) for x in facts], f).write.parquet(f"{tmp_path}/facts.parquet")
    spark.createDataFrame([("x", "UTC", "DMY")], "adapter_name string, tz string, date_order string").write.parquet(f"{tmp_path}/adapters.parquet")
    got = sorted((r["id"], r["subject"], r["object"], r["claimed"], r["held"], r["valid_to"], r["problem"]) for r in P.claim_check(spark, str(tmp_path)).collect())
    assert got == [
        ("a", "maria", "atlas", "owner", "owner", "2023-12-31", "stale_fact"),
        ("a", "maria", "atlas", "owner", "sponsor", None, "relationship_mismatch"),
        ("a", "maria", "atlas", "owner", "works_on", None, "relationship_mismatch"),
        ("b", "shared_memory_hub", "atlas", "owner", "uses", None, "relationship_mismatch"),
        ("c", "ledger", "warm_pipeline", "covers", "follows", None, "relationship_mismatch"),
    ]
