from __future__ import annotations

import random

from pyspark.sql import functions as F

from memloom.operators import history as H

SCHEMA = "subject string, predicate string, object string, id long, start long, end long, arrived string"
S = H.SECOND


def brute(rows):
    best = {}
    for s, p, o, i, start, end, _ in rows:
        if None not in (s, p, o, start) and (start not in best.setdefault((s, p), {}) or best[s, p][start][0] < i):
            best[s, p][start] = (i, o, end)
    out = set()
    for (s, p), by in best.items():
        versions = []
        for start in sorted(by):
            _, o, end = by[start]
            if versions and versions[-1][0] == o and (versions[-1][2] is None or versions[-1][2] >= start - S):
                versions[-1][2] = end
            else:
                versions.append([o, start, end])
        for k, (o, start, end) in enumerate(versions):
            nxt = versions[k + 1][1] if k + 1 < len(versions) else None
            out.add((s, p, o, start, min((x for x in (end, nxt) if x is not None), default=None)))
    return out


def made(n, seed, keys=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.randrange(0, 200) * S
        end = r.choice([None, None, start + r.randrange(0, 40) * S])
        key = 0 if r.random() < 0.4 else r.randrange(keys)
        rows.append((f"s{key}", "p", r.choice("abc"), i, start, end, f"2024-01-{r.randrange(1, 28):02d} 00:00:00"))
    rows += rows[: n // 50]  # delivered twice
    r.shuffle(rows)
    return rows


def current(h):
    return {tuple(r) for r in h.where("retired IS NULL").select("subject", "predicate", "object", "starts", "ends").collect()}


def test_against_brute_force(spark):
    rows = made(400, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert current(H.history_of(df)) == brute(rows)


def test_hot_key_in_stretches(spark):
    rows = made(300, 2, keys=2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert current(H.history_of(df, periods=2, key_rows=20)) == brute(rows)


def test_snapshots_keep_what_they_said(spark):
    rows = [("s", "p", "a", 1, 0, None, "2024-01-01 00:00:00"), ("s", "p", "b", 2, 10 * S, None, "2024-01-09 00:00:00"), ("t", "p", "x", 3, 0, None, "2024-01-01 00:00:00")]
    h = H.history_of(spark.createDataFrame(rows, SCHEMA), periods=2)
    got = {(r["subject"], r["object"], r["ends"], r["retired"] is None) for r in h.collect()}
    assert got == {("s", "a", None, False), ("s", "a", 10 * S, True), ("s", "b", None, True), ("t", "x", None, True)}


def test_only_changed_leaves(spark):
    rows = made(200, 3, keys=40)
    bits = 8
    old = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", H.leaf_of(bits))
    new = old.withColumn("object", F.when(F.col("subject") == "s7", "z").otherwise(F.col("object")))
    changed = {r["leaf"] for r in H.changed_leaves(H.tree(old, bits), H.tree(new, bits)).collect()}
    assert changed == {r["leaf"] for r in old.where("subject = 's7'").select("leaf").distinct().collect()}


def test_descent_visits_few_nodes(spark):
    """Of snapshots most of whose leaves are equal, only the ways to the changed leaves are compared, and only those leaves
    are derived again."""
    rows = [(f"s{k}", "p", "a", k, 0, None, None) for k in range(3000)]
    bits = H.leaf_bits(len(rows))
    old = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", H.leaf_of(bits))
    new = old.withColumn("object", F.when(F.col("subject").isin("s7", "s70"), "z").otherwise(F.col("object")))
    trees = H.tree(old, bits), H.tree(new, bits)
    total = [level.count() for level in reversed(trees[0])]
    visited = [level.count() for level in H.descended(*trees)]
    assert total[0] == 1 and total[-1] > 500
    assert visited[0] == 1 and max(visited) == 2
    derived = new.join(H.changed_leaves(*trees), "leaf", "left_semi").select("subject").distinct().count()
    assert 2 <= derived <= 30


def test_nulls_and_empty(spark):
    rows = [(None, "p", "a", 1, 0, None, None), ("s", None, "a", 2, 0, None, None), ("s", "p", None, 3, 0, None, None), ("s", "p", "a", 4, None, None, None), ("s", "p", "a", 5, 0, None, None)]
    assert current(H.history_of(spark.createDataFrame(rows, SCHEMA))) == {("s", "p", "a", 0, None)}
    assert H.history_of(spark.createDataFrame([], SCHEMA)).count() == 0
