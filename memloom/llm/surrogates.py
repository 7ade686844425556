"""Keyed surrogates for personal data, made from the parts of a passage.

A passage is taken apart: a name into given names, initials and family names, an address of mail or street into its words and
digits, a number into its digits. Every part has a keyed replacement of its own kind, so that "Anna Berg", "Berg, Anna" and "A. BERG"
stay one person, an address of mail keeps the name of its owner, and a number stays the same with and without country code. Particles,
kinds of street, separators, case, gender, country codes and the number of digits stay as they are.

Replacements are settled for the whole corpus: those that meet another one or a part that occurs in the texts are made again, longer,
until none does. So different passages stay different and no surrogate is a passage of the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm import pii
from memloom.session import written

#: Rounds of settling after which something must be wrong (each draws anew and words grow longer).
ROUNDS = 100
_SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
_PARTICLES = frozenset("van von zu der den de di da del la le du des dos".split())
_COUNTRY = re.compile(r"\s*\(?(?:\+|00)\)?\s*(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")  # lengths of country codes
_STREET_WORD = re.compile(rf"(?i:(?:{pii._EN}|{pii._FR}|stra(?:ß|ss)e|str|{pii._DE})\.?|c/|calle|avenida|avda|plaza|pza|paseo|camino|ronda|carretera|traves[ií]a|glorieta|bis|ter|quater|de|la|las|los|del|des|du|d|l|les|le|n|no|nº|n°)$")
_STEM = re.compile(rf"(?i:({pii._DE}))$")
_GERMAN = str.maketrans({"ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue"})
_RUN = re.compile(r"[^\W\d_]+|\d+|[\W_]+")


def fold(word: str) -> str:
    """Lower case without accents; umlauts as addresses of mail spell them."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().translate(_GERMAN)) if not unicodedata.combining(c))


_FEMALE, _MALE = frozenset(map(fold, pii.FEMALE)), frozenset(map(fold, pii.MALE))


def _case(word: str) -> str:
    return "upper" if len(word) > 1 and word.isupper() else "lower" if word.islower() else "title"


def _word(word: str, given: bool = False) -> tuple[str, str, str]:
    if len(word) == 1:
        return ("initial", fold(word)[:1], "lower" if word.islower() else "upper")
    return ("given" if given else "word", fold(word), _case(word))


def _name(passage: str) -> Iterator[tuple[str, str, str]]:
    comma = passage.find(",")
    words = [m for m in _RUN.finditer(passage) if m[0][0].isalpha()]
    ends = [m.end() for m in words if passage[m.end() : m.end() + 1] != "-"]
    for m in _RUN.finditer(passage):
        if not m[0][0].isalpha() or (m[0].lower() in _PARTICLES and len(words) > 1 and m[0].islower()):
            yield ("", m[0], "")
        elif comma >= 0:
            yield _word(m[0], m.start() > comma)
        else:  # the last word with all that hyphens and apostrophes tie to it is the family name
            tail = max((e for e in ends[:-1] if passage[e : e + 1] not in "-'’"), default=0) if len(ends) > 1 else 0
            yield _word(m[0], m.end() <= tail)


def _email(passage: str) -> Iterator[tuple[str, str, str]]:
    at = pii.AT.search(passage)
    local, domain = passage[: at.start()], passage[at.end() :]
    for m in _RUN.finditer(local):
        if m[0][0].isalpha():
            yield _word(m[0], fold(m[0]) in _FEMALE or fold(m[0]) in _MALE)
        else:
            yield ("digits", "mail", m[0]) if m[0].isdigit() else ("", m[0], "")
    yield ("", at[0], "")
    labels = re.split(f"({pii._DOT})", domain)
    for k, label in enumerate(labels):
        if k % 2:
            yield ("", label, "")
        elif k == len(labels) - 1:
            yield ("", "example", "")
        else:
            yield ("word", fold(label if k < len(labels) - 3 else f"{label}.{labels[-1]}"), _case(label))


def _digits_of(passage: str, kind: str) -> tuple[str, str, str]:
    """One part: the letters and digits to be replaced, and the passage with ``#`` in their places."""
    keep = 0
    if kind == "phone":
        m = _COUNTRY.match(passage)
        keep = m.end() if m else 0
        own = passage[keep:]
        if not m and len(re.sub(r"\D", "", passage)) == 11 and passage.lstrip(" (")[:1] == "1":
            keep = passage.index("1") + 1  # North America with its code
        elif zero := re.match(r"[ ./-]*(?:\(0\)|\(?0)", own):
            keep += zero.end()  # trunk prefix
    form, key = passage[:keep], ""
    for c in passage[keep:]:
        if c.isdigit() or (kind == "national_id" and c.isalpha()):
            key += c.upper()
            form += "#"
        else:
            form += c
    return (kind, key, form)


def _street(passage: str) -> Iterator[tuple[str, str, str]]:
    street = "".join(fold(m[0]) for m in _RUN.finditer(passage) if len(m[0]) > 1 and m[0][0].isalpha())
    for m in _RUN.finditer(passage):
        w = m[0]
        if w.isdigit():
            yield ("digits", street, w)
        elif not w[0].isalpha() or len(w) == 1 or _STREET_WORD.match(w):
            yield ("", w, "")
        else:
            stem = _STEM.search(w)
            head = w[: stem.start()] if stem and stem.start() > 1 else w
            yield _word(head)
            yield ("", w[len(head) :], "")


def parts(kind: str, passage: str) -> list[tuple[str, str, str]]:
    """(what, key, form) of the parts of a passage in order; ``what`` is empty for text that stays."""
    if kind == "name":
        return list(_name(passage))
    if kind == "street":
        return list(_street(passage))
    if kind == "email" and pii.AT.search(passage):
        return list(_email(passage))
    return [_digits_of(passage, kind)]


def _draw(secret: str, *of: str) -> bytes:
    return hmac.new(secret.encode(), "|".join(of).encode(), hashlib.sha256).digest()


@lru_cache(4)
def _letters(secret: str) -> dict[str, str]:
    """A keyed permutation of the letters."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    return dict(zip(plain, sorted(plain, key=lambda c: _draw(secret, "letter", c)), strict=True))


def _shifted(text: str, secret: str, *of: str) -> str:
    """Digits and letters moved by a keyed distance that hangs on what stands before: different texts stay different."""
    out = []
    for k, c in enumerate(text):
        by = int.from_bytes(_draw(secret, *of, text[:k])[:4], "big")
        if c.isdigit():
            n = int(c)
            count = k == 0 and of[0] == "digits"  # a count such as a house number begins with no zero
            out.append(str(n if count and n == 0 else (n - 1 + by) % 9 + 1 if count else (n + by) % 10))
        elif c.isascii() and c.isalpha():
            out.append(chr((ord(c.upper()) - 65 + by) % 26 + 65))
        else:
            out.append(c)
    return "".join(out)


def replacement(what: str, key: str, secret: str, salt: int = 0) -> str:
    """The keyed replacement of a part, in lower case; words grow with ``salt``."""
    if what in ("phone", "national_id"):
        return _shifted(key, secret, what, str(salt))
    stream = _draw(secret, what, key, str(salt)) + _draw(secret, key, what, str(salt))
    tail = "".join(_SYLLABLES[b % len(_SYLLABLES)] for b in stream[: min(40, 3 + salt // 2)])
    if what == "given":
        first = _letters(secret).get(key[:1], "x")
        ending = "na" if key in _FEMALE else "no" if key in _MALE else "ne"
        return first + ("" if first in "aeiou" else "aeiou"[stream[-1] % 5]) + tail[: 2 * (2 + salt // 2)] + ending
    return tail + "lmnrst"[stream[-2] % 6]


def rendered(what: str, key: str, form: str, made: str | None, secret: str) -> str:
    """The text of a part in its form."""
    if not what:
        return key
    if what == "digits":
        return _shifted(form, secret, "digits", key)
    if what in ("phone", "national_id"):
        it = iter(made)
        return "".join(next(it) if c == "#" else c for c in form)
    word = _letters(secret).get(key, "x") if what == "initial" else made
    return word.upper() if form == "upper" else word if form == "lower" else word.title()


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(kind, p, i, *part) for kind, p in zip(b.column("kind").to_pylist(), b.column("passage").to_pylist(), strict=True) for i, part in enumerate(parts(kind, p))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 2 else pa.string()) for k in range(6)], ["kind", "passage", "i", "what", "key", "form"])


def settled(parts: DataFrame, secret: str) -> DataFrame:
    """(what, key, made): a replacement for every distinct part (what, key). Within words (given names among them) and within each
    kind of number all replacements are different and none is itself a part; those that fail are drawn again."""

    @F.pandas_udf("string")
    def drawn(what: pd.Series, key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([replacement(w, k, secret, int(s)) for w, k, s in zip(what, key, salt, strict=True)], dtype=object)

    pool = F.when(F.col("what") == "given", "word").otherwise(F.col("what"))
    parts = written(parts.distinct().withColumn("pool", pool))
    real = parts.select("pool", F.col("key").alias("made"), F.lit(True).alias("real")).distinct()
    todo, done = parts, None
    for salt in range(ROUNDS):
        new = todo.withColumn("salt", F.lit(salt)).withColumn("made", drawn("what", "key", "salt")).drop("salt").join(real, ["pool", "made"], "left")
        new = new.select("pool", "what", "key", "made", "real", F.lit(1).alias("old"))
        if done is not None:
            new = new.unionByName(done.select("pool", "what", "key", "made", F.lit(None).cast("boolean").alias("real"), F.lit(0).alias("old")))
        ranked = written(new.withColumn("rank", F.row_number().over(Window.partitionBy("pool", "made").orderBy("old", "real", "what", "key"))))
        good = (F.col("rank") == 1) & F.col("real").isNull()
        done, todo = ranked.where(good).select("pool", "what", "key", "made"), ranked.where(~good).select("pool", "what", "key")
        if todo.isEmpty():
            return done.drop("pool")
    raise RuntimeError("no free surrogates are left for some kind of number")


def surrogates(passages: DataFrame, secret: str) -> DataFrame:
    """(kind, passage, surrogate): one row for each distinct (kind, passage) of ``passages``; nulls take no part. ``secret``: the
    key, without which a surrogate can't be traced to its passage."""
    own = passages.select("kind", "passage").where("kind IS NOT NULL AND passage IS NOT NULL").distinct()
    p = written(own.mapInArrow(_taken_apart, "kind string, passage string, i int, what string, key string, form string"))
    made = settled(p.where(F.col("what").isin("word", "given", "phone", "national_id")).select("what", "key"), secret)

    @F.pandas_udf("string")
    def text(what: pd.Series, key: pd.Series, form: pd.Series, made: pd.Series) -> pd.Series:
        return pd.Series([rendered(*r, secret) for r in zip(what, key, form, made, strict=True)], dtype=object)

    whole = F.array_sort(F.collect_list(F.struct("i", "t")))
    t = p.join(made, ["what", "key"], "left").select("kind", "passage", "i", text("what", "key", "form", "made").alias("t"))
    return t.groupBy("kind", "passage").agg(F.array_join(F.transform(whole, lambda x: x["t"]), "").alias("surrogate"))


def replacements(df: DataFrame, secret: str, key: str = "id", text: str = "content") -> DataFrame:
    """(id, hash, kind, start, end, passage, surrogate): every passage of personal data with its place (characters from 0) and its
    surrogate. ``hash`` is that of the text, so that an id with several texts is kept apart. Null and empty texts hold none,
    repeated rows count once, other columns are ignored."""
    found = written(pii.located(df, key, text).distinct())
    return found.join(surrogates(found, secret), ["kind", "passage"])


def pseudonymised(df: DataFrame, secret: str, key: str = "id", text: str = "content") -> DataFrame:
    """(id, content): each distinct text with surrogates in place of its personal data, all else unchanged; null stays null."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            if own is not None and t is not None:
                at, new = 0, []
                for s in sorted(own, key=lambda x: x["start"]):
                    new += [t[at : s["start"]], s["surrogate"]]
                    at = s["end"]
                t = "".join(new) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    # The passages of one text.
    spans = replacements(df, secret, key, text).groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end", "surrogate")).alias("spans"))
    base = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("content")).distinct().withColumn("hash", F.xxhash64("content"))
    clean, marked = base.join(spans.select("id", "hash"), ["id", "hash"], "left_anti"), base.join(spans, ["id", "hash"])
    return clean.select("id", "content").unionByName(marked.select("id", put("content", "spans").alias("content")))
