"""Names within two edits, against brute force."""

from __future__ import annotations

import random

from memloom.operators import kg as K
from memloom.plans import kg as P


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_all_pairs_within_two_edits(spark):
    r = random.Random(3)
    names = {"", "a", "ab", "xyz", "maria_lopez", "aria_lopez", "mraia_lopez", "maria_lopezzz", "żółw", "zolw", "żółwie"}
    for _ in range(40):
        base = "".join(r.choice("abcd_") for _ in range(r.randrange(3, 15)))
        names.add(base)
        for _ in range(3):
            x = list(base)
            for _ in range(r.randrange(1, 4)):
                x[(k := r.randrange(len(x) + 1)) : k + r.randrange(2)] = r.choice(["", "a", "z"])
            names.add("".join(x))
    df = spark.createDataFrame([(n,) for n in [*names, None, "xyz"]], "name string")
    want = {(a, b) for a in names for b in names if a < b and 1 <= distance(a, b) <= 2}
    assert {tuple(x) for x in K.near_names(df).collect()} == want


def test_all_names_of_the_graph_take_part(spark, tmp_path):
    rows = [(1, "Maria Lopez", "uses", "Atlas"), (2, "aria lopez", "owned_by", "Atals"), (3, "Bob", "cites", None)]
    f = spark.createDataFrame([(*x, None, None, 1.0, "x", None, None) for x in rows], "id long, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, adapter_name string, source_entity_id string, created_at string")
    f.write.parquet(f"{tmp_path}/facts.parquet")
    assert {tuple(x) for x in P.similar_names(spark, str(tmp_path)).collect()} == {("aria_lopez", "maria_lopez"), ("atals", "atlas")}
