"""Operators for training data against brute force, and their edge cases."""

from __future__ import annotations

import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import knn, leak, mix, neardup, pii, quality, split, surrogates
from memloom.llm.queries import QUERIES, SQL
from tests.oracle import difference, duck

WORD = re.compile(r"[^\W_]+")
VOCABULARY = "alder birch cedar dune ember fjord grove heath inlet jetty knoll lagoon marsh nook orchard pond quarry ridge shoal tarn upland vale weir yard zenith".split()


def sentence(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


# Near-duplicates


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def groups_by_force(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        if i is not None and len(w) >= neardup.LEAST_WORDS:
            sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.6 * (len(sets[a]) + len(sets[b]) - both):
            at[root(a)] = root(b)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if root(a) == root(b)}


def test_near_duplicates(spark):
    r = random.Random(1)
    rows = []
    for g in range(12):
        base = sentence(r, 80)
        rows += [(f"g{g}_{k}", edited(r, base, r.choice([0, 1, 3, 5]))) for k in range(5)]
    rows += [(f"hot{k:02d}", "The same text again and again " + sentence(random.Random(0), 40)) for k in range(30)]
    rows += [("short", "too few words"), ("null", None), (None, sentence(r, 50)), ("empty", ""), rows[0], ("long", sentence(r, 30_000))]
    df = spark.createDataFrame([(*x, 7, "x") for x in rows], "id string, content string, cls int, label string")
    got = neardup.group_pairs(neardup.near_duplicates(df), block=8)
    assert got.count() == got.distinct().count()
    assert {tuple(x) for x in got.collect()} == groups_by_force(rows)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert neardup.near_duplicates(df).count() == 0


def test_thresholds_meet_the_pigeonhole():
    costs = np.array([[1.0, 4.0, 90.0], [50.0, 400.0, 9000.0], [1.0, 2.0, 3.0]])
    t = neardup.allot(costs, 4)
    assert sum(x + 1 for x in t) == 5 and t[1] == -1
    r = random.Random(2)
    for _ in range(300):  # any code within the radius meets in some partition
        a = np.random.default_rng(r.random().__hash__() & 0xFFFF).integers(0, 99, (1, neardup.UNITS), dtype=np.uint16)
        b = a.copy()
        for k in r.sample(range(neardup.UNITS), neardup.RADIUS):
            b[0, k] += 100
        t = [1] * neardup.PARTS
        assert any(set(neardup.part_keys(a, p, t[p])[0]) & set(neardup.part_keys(b, p, t[p])[0]) for p in range(neardup.PARTS))


def test_chains_of_links(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["label"] for r in neardup.components(e).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# Nearest vectors


def vectors(n, seed=0, dim=knn.DIM):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.7 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def recall_of(got, ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :5]
    return sum(ids[j] in got.get(ids[i], ()) for i in range(len(ids)) for j in top[i]) / (5 * len(ids))


def test_recall_and_edges(spark, monkeypatch):
    for name, n in (("CELL_ROWS", 100), ("TASK_ROWS", 60), ("TASK_QUERIES", 90)):  # cells, several indexes and blocks of queries at a small size
        monkeypatch.setattr(knn, name, n)
    x = vectors(1000)
    x[:300] = x[0] + 0.05 * np.random.default_rng(5).normal(size=(300, knn.DIM))  # a hot group
    rows = [(f"v{k:04d}", [float(y) for y in v], 1) for k, v in enumerate(x)]
    rows += [rows[5], ("null", None, 1), ("zero", [0.0] * knn.DIM, 1), ("short", [1.0] * 5, 1), ("nan", [float("nan")] * knn.DIM, 1), ("hole", [None] + [1.0] * (knn.DIM - 1), 1)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, others int")
    got = {r["id"]: r["others"] for r in knn.nearest(df).collect()}
    assert set(got) == {f"v{k:04d}" for k in range(1000)}
    assert recall_of(got, [f"v{k:04d}" for k in range(1000)], x) >= 0.9
    assert all(len(o) == len(set(o)) <= 5 and i not in o for i, o in got.items())


@pytest.mark.parametrize("cells", [1, 8, 32, 128, 1000])
def test_recall_by_number_of_cells(spark, monkeypatch, cells):
    """The recall with as many cells as tables of 16 thousand to 16 million rows get, on the vectors of docs."""
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    df = spark.read.parquet(f"{d}/docs.parquet")
    monkeypatch.setattr(knn, "CELL_ROWS", -(-df.count() // cells))
    rows = {r["id"]: r["vector"] for r in df.select("id", "vector").collect() if r["vector"] is not None and len(r["vector"]) == knn.DIM}
    x = np.array(list(rows.values()), np.float32)
    good = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
    got = {r["id"]: r["others"] for r in knn.nearest(df).collect()}
    assert recall_of(got, np.array(list(rows))[good], x[good]) >= (0.97 if cells < 1000 else 0.9)  # four rows a cell, here


def test_equal_vectors(spark):
    """A third of all rows share one vector: each is nearest to the largest others, all get a row, others find them too."""
    x = vectors(200)
    rows = [(f"v{k:04d}", [float(y) for y in (x[0] if k < 70 else x[k])]) for k in range(200)]
    got = {r["id"]: r["others"] for r in knn.nearest(spark.createDataFrame(rows + rows[:80], "id string, vector array<float>")).collect()}
    assert set(got) == {r[0] for r in rows}
    want = [f"v{k:04d}" for k in range(69, 63, -1)]
    assert all(got[f"v{k:04d}"] == [w for w in want if w != f"v{k:04d}"][:5] for k in range(70))


def test_twelve_bits():
    x = np.random.default_rng(1).normal(size=(50, 7)).astype(np.float32)
    whole = knn.unpacked(knn.packed(x), 7)
    assert np.abs(whole / 2047 * np.abs(x).max(1, keepdims=True) - x).max() <= np.abs(x).max() / 4000


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [(f"v{k}", [float(k + 1)] * knn.DIM) for k in range(n)]
    out = knn.nearest(spark.createDataFrame(rows, "id string, vector array<float>")).collect()
    assert len(out) == (2 if n == 2 else 0)


# Splitting


@pytest.mark.parametrize("text", ["x" * 5000, "word " * 1500, ("A sentence here. " * 20 + "\n\n") * 20, "行。" * 3000, "a\n" * 4000, " " * 4500])
def test_pieces_give_the_text_back(text):
    s = split.spans(text)
    end, whole = 0, ""
    for lo, hi in s:
        assert hi - lo <= split.LIMIT and lo == (max(0, end - split.OVERLAP) if end else 0)
        whole += text[end:hi]
        end = hi
    assert whole == text


def test_cuts_fall_at_paragraphs(spark):
    text = "\n\n".join(["p" * 300] * 12)
    df = spark.createDataFrame([("t", "a", text, 1), ("t", "b", None, 1), ("t", "c", "", 1), ("t", "d", "x" * 2000, 1)], "tbl string, id string, text string, piece int")
    out = split.pieces(df).orderBy("piece").collect()
    assert {r["id"] for r in out} == {"a"} and all(text[: r["ends"]].endswith("\n\n") for r in out[:-1])


# Personal data

FOUND = [
    ("Write to anna.berg+x@mail.example.org now", ["email:annabergxmailexampleorg"]),
    ("ask tom-smith [at] corp [dot] test or TOM@CORP.TEST", ["email:tomsmithatcorpdottest", "email:tomcorptest"]),
    ("require('small-lamp@1.2.3') and @cached(ttl=3)", []),
    ("Call +44 20 7946 0958 or (212) 555-0123, else 415.555.0199", ["phone:442079460958", "phone:2125550123", "phone:4155550199"]),
    ("Tel 16465550123; Epoch 17482345678; host 192.0.2.17", ["phone:16465550123"]),
    ("Rückruf unter 030/23125259 oder +49 (0)30 23125-507", ["phone:03023125259", "phone:4903023125507"]),
    ("Appelez le 01 99 00 12 34. Llama al 900 000 123.", ["phone:0199001234", "phone:900000123"]),
    ("ID 912-34-5678, part no. 8817-58-8, QQ 12 34 56 C", ["national_id:912345678", "national_id:qq123456c"]),
    ("Llama al +34 900 000 531 o (+34) 900000228", ["phone:34900000531", "phone:34900000228"]),
    ("Steuer-ID 00216230247, DNI 00331122-H", ["national_id:00216230247", "national_id:00331122h"]),
    ("Numéro de sécurité sociale 2 82 13 99 536 527 19", ["national_id:282139953652719"]),
    ("He lives at 141 Wherry Way, Norrfeld", ["street:141wherryway"]),
    ("Ziegelstraße 188, Turmstr. 72a", ["street:ziegelstraße188", "street:turmstr72a"]),
    ("au 175, rue des Vieux Ponts et Calle de la Fuente 22", ["street:175ruedesvieuxponts", "street:calledelafuente22"]),
    ("met Oliver B. Hazelquist and Kellenholt, Marek near Oslo", ["name:oliverbhazelquist", "name:kellenholtmarek"]),
    ("by J. Fennander and WANDA GRIED", ["name:jfennander", "name:wandagried"]),
    ("Lake Casviven and Mount Ravvarun are only names", []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_passages(text, want):
    got = [f"{k}:" + "".join(c for c in text[lo:hi].lower() if c.isalnum()) for k, lo, hi in pii.found_in(text)]
    assert sorted(got) == sorted(want)


def test_placeholders_change_nothing_else():
    assert pii.redacted("Ask Anna Berg <anna@x.example> at 5 Elm Road!") == "Ask [NAME] <[EMAIL]> at [STREET]!"
    assert pii.redacted("nothing here\n\n ok") == "nothing here\n\n ok"


UNLISTED = ("Priyanka Sharma", "Wei Zhang", "Brandon Carter", "Kwame Mensah", "Chioma Okafor", "Bartosz Nowak", "Siobhan O'Neill", "Matteo Ricci", "Ingeborg Lindqvist", "Tariq Aziz-Khan", "Xiomara de la Cruz", "Håkon Bjørnstad")
SURROUNDINGS = (
    "Dr. {n} called about the {w}.", "The {w} was signed by {n} (ID 12).", "reviewer: {n}; {w} is open", "{n} lives at the {w}.", "{n} can be reached at the {w}.", "Herr {n} wohnt hier.",
    "Mme {n} répond au {w}.", "La Sra. {n} atiende en el {w}.", "| {n} | info@{w}.example", "{{\"author\": \"{n}\", \"mail\": 1}}", "Mit freundlichen Grüßen\n{n}", "My name is {n}.", "We met {n} near the {w}.", "{n} said that the {w} was late.", "Anna Berg and {n} left the {w}.",
)


def test_names_that_no_list_has():
    assert not {n.split()[0] for n in UNLISTED} & set(pii.FEMALE + pii.MALE)
    texts = [(n, s.format(n=n, w=VOCABULARY[k % len(VOCABULARY)])) for k, n in enumerate(UNLISTED) for s in SURROUNDINGS]
    hit = sum(any(kind == "name" and t[a:b] == n for kind, a, b in pii.found_in(t)) for n, t in texts)
    assert hit >= 0.95 * len(texts)


@pytest.mark.parametrize("text", ["Lake Morrow said no.", "New York met all plans.", "The Red Door was closed by Monday.", "In Aldvik, Winter Harbour is quiet.", "Chapter Seven asked too much.", "Apparently Norrick thinks so."])
def test_other_capitals_are_no_names(text):
    assert pii.found_in(text) == []


def surrogate_of(spark, *passages):
    df = spark.createDataFrame([*passages, passages[0], (None, "x"), ("name", None)], "kind string, passage string")
    return {(r["kind"], r["passage"]): r["surrogate"] for r in surrogates.surrogates(df, "k").collect()}


def test_spellings_of_one_person_stay_one(spark):
    one = surrogate_of(spark, *(("name", n) for n in ("Anna Schmidt", "Schmidt, Anna", "A. Schmidt", "ANNA SCHMIDT", "Paul Schmidt")), ("email", "anna.schmidt85@lab.example"), ("email", "anna.schmidt86@lab.example"))
    given, family = one["name", "Anna Schmidt"].split(" ")
    assert one["name", "Schmidt, Anna"] == f"{family}, {given}" and one["name", "A. Schmidt"] == f"{given[0]}. {family}" and one["name", "ANNA SCHMIDT"] == f"{given} {family}".upper()
    other = one["name", "Paul Schmidt"].split(" ")
    assert other[1] == family and other[0] != given and given.endswith("na") and other[0].endswith("no")
    mail = re.fullmatch(r"(\w+)\.(\D+)\d\d@[a-z]+\.example", one["email", "anna.schmidt85@lab.example"])
    assert mail.groups() == (given.lower(), family.lower()) and one["email", "anna.schmidt86@lab.example"] != mail[0]


def test_forms_stay(spark):
    one = surrogate_of(spark, ("phone", "+49 (0)30 23125-507"), ("phone", "030 23125507"), ("phone", "+1-312-555-0155"), ("street", "Hauptstraße 12"), ("street", "4, rue des Vieux Ponts"), ("street", "46B Saddler Road"), ("national_id", "QQ 12 34 56 C"), ("name", "Anna van der Berg"))
    a, b = one["phone", "+49 (0)30 23125-507"], one["phone", "030 23125507"]
    assert re.fullmatch(r"\+49 \(0\)\d\d \d{5}-\d{3}", a) and re.sub(r"\D", "", a)[3:] == b.replace(" ", "")[1:] and one["phone", "+1-312-555-0155"].startswith("+1-")
    for passage, form, gone in (("Hauptstraße 12", r"\w+straße \d\d", "Haupt"), ("4, rue des Vieux Ponts", r"\d, rue des \w+ \w+", "Ponts"), ("46B Saddler Road", r"\d\dB \w+ Road", "Saddler")):
        assert re.fullmatch(form, one["street", passage]) and gone not in one["street", passage]
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", one["national_id", "QQ 12 34 56 C"]) and " van der " in one["name", "Anna van der Berg"]


def test_surrogates_are_distinct_new_and_complete(spark):
    """Small spaces, in which collisions with each other and with real passages are certain: no row is lost."""
    many = spark.range(3000).select(F.lit("national_id").alias("kind"), F.format_string("%03d", F.col("id") % 300).alias("passage"))
    roads = spark.range(400).select(F.lit("street").alias("kind"), F.format_string("%d Elm Road", F.col("id") + 1).alias("passage"))
    out = surrogates.surrogates(many.unionByName(roads), "k").collect()
    real, made = {r["passage"] for r in out}, [r["surrogate"] for r in out]
    assert len(out) == 700 and len(set(made)) == 700 and not real & set(made)
    assert out == surrogates.surrogates(many.unionByName(roads), "k").collect() or sorted(map(tuple, out)) == sorted(map(tuple, surrogates.surrogates(many.unionByName(roads), "k").collect()))


def test_texts_with_surrogates(spark):
    rows = [("a", "Anna Berg met Paul Stone, +44 20 7946 0958. 🙂 Anna Berg!", 1), ("a", "Anna Berg met Paul Stone, +44 20 7946 0958. 🙂 Anna Berg!", 2), ("b", "nothing here", 1), ("c", None, 1), ("d", "", 1), (None, "Anna Berg", 1)]
    out = {r["id"]: r["content"] for r in surrogates.pseudonymised(spark.createDataFrame(rows, "id string, content string, kind int"), "k").collect() if r["id"]}
    assert (out["b"], out["c"], out["d"]) == ("nothing here", None, "")
    m = re.fullmatch(r"(\w+ \w+) met (\w+ \w+), \+44 \d\d \d{4} \d{4}\. 🙂 (\w+ \w+)!", out["a"])
    assert m[1] == m[3] != m[2] and "Berg" not in out["a"]
    assert surrogates.pseudonymised(spark.createDataFrame([], "id string, content string"), "k").count() == 0


def test_long_text_with_personal_data(spark):
    df = spark.createDataFrame([("a", "lorem ipsum " * 50_000 + "anna@x.example")], "id string, content string")
    assert [tuple(r) for r in pii.personal_data(df).collect()] == [("a", "email", "anna@x.example")]


# Leaks


@pytest.mark.parametrize("most", [{}, {"cell_bits": 8, "filter_bits": 8}])
def test_leaks(spark, most):
    """Small tables let many false candidates through; the result is the same."""
    r = random.Random(3)
    items = [(k, sentence(r, 40)) for k in range(30)] + [(90, None), (91, "few words"), (92, "")]
    docs = []
    for k in range(200):
        text = sentence(r, r.randrange(5, 200))
        if k % 3 == 0:
            w = items[r.randrange(30)][1].split()
            n = r.choice([14, 15, 16, 40])
            at = r.randrange(0, 41 - n)
            text = sentence(r, r.randrange(0, 30)) + " " + ", ".join(w[at : at + n]).upper() + " " + sentence(r, r.randrange(0, 30))
        docs.append((k, text))
    docs += [(500, None), (501, ""), docs[0], docs[3]]
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = WORD.findall((t or "").lower()), WORD.findall((x or "").lower())
            runs = {tuple(b[k : k + 15]) for k in range(len(b) - 14)}
            if any(tuple(a[k : k + 15]) in runs for k in range(len(a) - 14)):
                want.add((d, i))
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    got = leak.leaks(df, spark.createDataFrame(items, "item_id long, text string"), **most)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20


def test_many_items_in_one_scan(spark, tmp_path):
    r = random.Random(5)
    texts = [sentence(r, 20) for _ in range(5000)]
    spark.createDataFrame([(k, f"{sentence(r, 30)} {texts[k * 7]} {sentence(r, 30)}") for k in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = leak.leaks(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/docs") == 1
    assert {tuple(x) for x in got.collect()} == {(k, k * 7) for k in range(100)}


def test_no_items(spark):
    docs = spark.createDataFrame([(1, sentence(random.Random(0), 50))], "doc_id long, text string")
    assert leak.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


# Mixing


def test_mix(spark):
    r = random.Random(4)
    docs = [(k, sentence(r, r.randrange(1, 60)), s) for k, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["low"] * 60 + ["other"] * 30 + [None] * 10)]
    docs += [(5000, None, "big"), (5001, "", "mid")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("low", 0.2, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    chosen, report = mix.mixed(df, targets)
    got = {x["source"]: x for x in report.collect()}
    for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("low", 0.2, 4)):
        assert abs(got[s]["actual_share"] - share) < 0.02 and got[s]["most_repeats"] <= most
    assert {x["source"] for x in chosen.collect()} == {"big", "mid", "low"}
    small, _ = mix.mixed(df, targets, size=2000)  # nested: a smaller budget takes a subset
    assert {x["doc_id"] for x in small.where("source = 'big'").collect()} <= {x["doc_id"] for x in chosen.collect()}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix.mixed(spark.createDataFrame([], "doc_id long, text string, source string"), targets)
    assert chosen.count() == 0 and [r["tokens"] for r in report.collect()] == [0]


# Quality

PROSE = ["Yesterday we walked along the river, and it was colder than we had thought.\nNobody minded much.", "so i told him that the key was under the mat and he went to look for it", "Der Garten war leer, denn die Kinder waren noch in der Schule.", "La maison était vide et les enfants n'étaient pas encore rentrés.", "El jardín estaba vacío porque los niños no habían llegado todavía.", "庭には誰もいなかった。子供たちはまだ学校にいたからだ。"]
OTHER = ["| a | b | c |\n|---|---|---|\n| 1 | x2 | 77 |\n| 2 | x3 | 91 |", '{"k": 1, "value": [1, 2, 3], "name": "x_y"}\n{"k": 2, "value": [], "name": "z"}', "def f(x):\n    return [i for i in range(x) if i % 2]\n", "2024-01-02 10:11:12 ERROR [w-1] rows=3 took=5ms id=ab12\n2024-01-02 10:11:13 INFO [w-2] rows=4 took=9ms id=cd34", "#one #two #three4 #five", "- milk\n- eggs (12)\n- brown bread\n- tea", "~~~~~~~~~~~~~~~~~\n*****************"]


def test_prose_or_not(spark):
    own = quality.Classifier()
    assert [t for t in PROSE if own.text(t)[1] > 0.5] == []
    assert [t for t in OTHER if own.text(t)[1] <= 0.5] == []


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, " \n ", 3), (4, "Hi there.", 3)], "doc_id long, text string, word_count int")
    got = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert got[1]["word_count"] == got[2]["word_count"] == got[3]["word_count"] == 0 and got[4]["word_count"] == 2 and got[4]["punctuated_lines"] == 1.0
    assert {r["doc_id"]: r["profile"] for r in quality.structure(df).collect()}[2] == "empty"


def test_divergence():
    p = np.array([0.5, 0.5, 0.0])
    d = quality.divergence(p[None], np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]))[0]
    assert d[0] == pytest.approx(0) and d[1] == pytest.approx(1)


# Registered queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, name):
    assert difference(spark, duck(sf_dir), QUERIES[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


# Held out: none of these is among the profiles' examples.
HELD_OUT_PROSE = [
    "Revenue rose 14% to $3.2 billion in Q3 2023, up from $2.8 billion a year earlier, the company said.", "Brandon Carter, Kwame Mensah and Priyanka Sharma met Wei Zhang in Boston.", "i dont know if we can make it on friday but lets try anyway",
    "The committee, which had met twice before, could not agree on a date for the next hearing.", "She said that **nothing** had changed since *March*, and that it would stay so.", "WE ARE CLOSED ON MONDAYS BECAUSE THE STAFF NEEDS A DAY OFF.",
    "User: how do I reset it?\nAssistant: Hold the button for five seconds, then let go.", "Als der Regen endlich aufhörte, gingen die Kinder noch einmal zum See hinunter.", "Le maire a promis que les travaux seraient finis avant la fin de l'année.",
    "La vecina del tercero nos contó que el ascensor llevaba dos semanas sin funcionar.", "昨日の会議では新しい予算について長い時間話し合いました。", "> We never got\n> an answer to the letter that we sent\n> in the first week of the year.",
    "Between 1998 and 2004 the town lost about 3,000 of its 21,000 inhabitants.", "Yes, I think so. Ask her tomorrow.", "Dr. Okafor wrote to Ingeborg Lindqvist that the samples from Lagos had arrived on Thursday.",
]
HELD_OUT_OTHER = [
    "- milk\n- bread\n- two onions\n- candles", "1. Preheat\n2. Mix\n3. Bake\n4. Cool", "| city | pop |\n|---|---|\n| Oslo | 709037 |\n| Bergen | 291940 |", "date;amount;currency\n2024-01-02;19.90;EUR\n2024-01-05;7.25;USD", "name\tage\tcity\nana\t31\tlugo\nbo\t44\tlund",
    "Jan 03 11:02:33 host7 sshd[812]: Failed password for root from 10.2.3.4 port 22\n2024-01-03 11:02:35,120 WARN pool-3 retry=2 code=502 in 88ms", "import os\n\nfor f in os.listdir(d):\n    if f.endswith('.tmp'):\n        os.remove(f)\n    else:\n        continue",
    "function add(a, b) {\n  return a + b;\n}\nconst x = add(1, 2);", "SELECT a.id, sum(b.v) FROM a JOIN b ON a.id = b.a_id\nWHERE b.ts > '2024-01-01'\nGROUP BY a.id;", '{"server": {"port": 8080, "tls": false},\n "paths": ["/a", "/b"]}', "[db]\nhost = 10.0.0.1\nport = 5432\nuser = app",
    "Home | Products | Pricing | Blog | Contact | Login", "#sunset #beach #holiday2023 #nofilter #friends", "stone tree stone 44 glass tree stone glass glass 44 stone tree tree glass stone", "cup, spoon, cup, cup, 88, plate, spoon, spoon, cup, 88, plate, cup", "=+=+=+=+=+=+=+=+ab12\n%%%%%%%%%%%%%%%%%%%%%%%",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgcHJvc2UgYXQgYWxsIGp1c3QgYnl0ZXM=",
]


def test_held_out_accuracy():
    own = quality.Classifier()
    wrong = [t for t in HELD_OUT_PROSE if own.text(t)[1] > 0.5] + [t for t in HELD_OUT_OTHER if own.text(t)[1] <= 0.5]
    assert not [t for t in HELD_OUT_PROSE[:2] if t in wrong]
    assert len(wrong) <= 0.07 * len(HELD_OUT_PROSE + HELD_OUT_OTHER), wrong


def test_one_pass_over_the_texts(spark, tmp_path):
    rows = [(1, "The old door was open, and nobody knew why.", "x"), (2, None, "x"), (3, "", "x"), (4, "a,b,c\n1,2,3\n4,5,6", "x"), (4, "a,b,c\n1,2,3\n4,5,6", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, profile string").write.parquet(f"{tmp_path}/documents.parquet")
    out = quality.p9_profiles(spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["doc_id"]: (r["word_count"], r["is_prose"]) for r in out.collect()}
    assert got == {1: (9, True), 2: (0, True), 3: (0, True), 4: (9, False)}


def test_shares_reached_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    rows = QUERIES["p8_report"](spark, d).collect()
    assert len(rows) == 12 and max(abs(r["actual_share"] - r["target_share"]) for r in rows) < 0.002
