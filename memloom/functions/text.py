"""Chunking, extraction and classification of texts, as Column expressions where built-ins suffice."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from memloom.functions import markers as M

def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the lower-cased text contains."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def first_best(scores: dict[str, Column], none: str) -> Column:
    """The name of the greatest score, the first of equals; ``none`` if all are 0."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best <= 0, none)
    for name, s in scores.items():
        out = out.when(s == best, name)
    return out


def topic(text: Column) -> Column:
    return first_best({k: hits(text, w) for k, w in M.TOPICS.items()}, "general")


def gate(text: Column) -> Column:
    return first_best({k: hits(text, w) for k, w in M.GATES.items()}, "general")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def segments(text: Column) -> Column:
    """Turns of a conversation of at least three, else paragraphs, else (one paragraph of more than 20 lines) groups of 25 lines;
    without blank ones."""
    turns = F.split(F.regexp_replace(text, f"({M.TURN})", "\x01$1"), "\x01")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda x: x != "")
    groups = line_groups(text)
    some = F.when(count_of(text, M.TURN) >= 3, turns).when((F.size(paragraphs) <= 1) & (F.size(F.split(text, "\n")) > 20), groups).otherwise(paragraphs)
    return F.filter(F.transform(some, stripped), lambda x: x != "")


FENCE = r"(?ms)^\s*```.*?(?:^\s*```[^\n]*$|\z)"


def prose(segment: Column) -> Column:
    """A segment without lines of code; the segment if nothing is left."""
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    code = lambda x: x.rlike(M.CODE_LINE) | ((F.length(x) > 10) & (letters(x) < 0.4 * F.length(x)))
    kept = F.filter(F.split(F.regexp_replace(segment, FENCE, ""), "\n"), lambda x: ~code(F.trim(x)))
    return F.coalesce(F.nullif(stripped(F.array_join(kept, "\n")), F.lit("")), segment)


def memory_scores(lower: Column) -> dict[str, Column]:
    """How often the markers of each kind of memory occur."""
    return {k: reduce(lambda a, b: a + b, [count_of(lower, p) for p in ps]) for k, ps in M.MEMORY_TYPES.items()}


def memory_type(df: DataFrame, segment: str, lower: str) -> DataFrame:
    """Adds ``kind`` (``none`` without any marker) and ``confidence`` of each segment; ``lower`` is its prose in lower case. Longer segments
    score higher; a problem that was solved is a milestone, or emotional where the feeling is good."""
    df = df.withColumns({f"_{k}": c for k, c in memory_scores(F.col(lower)).items()})
    s = {k: F.col(f"_{k}") for k in M.MEMORY_TYPES}
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\w+"), F.lit(0)))
    of = lambda ws: F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))
    good = of(M.POSITIVE) > of(M.NEGATIVE)
    bonus = F.when(F.length(segment) > 500, 2).when(F.length(segment) > 200, 1).otherwise(0)
    best = F.greatest(*s.values())
    solved = F.when((s["emotional"] > 0) & good, "emotional").otherwise("milestone")
    kind = first_best(s, "none")
    unsolved = F.when(good & (s["milestone"] > 0), "milestone").when(good & (s["emotional"] > 0), "emotional").otherwise("problem")
    kind = F.when(kind == "problem", F.when(F.col(lower).rlike(M.RESOLVED), solved).otherwise(unsolved)).otherwise(kind)
    confidence = F.round(F.when(best > 0, F.least(F.lit(1.0), (best + bonus) / 5.0)).otherwise(0.0), 6)
    return df.withColumns({"kind": kind, "confidence": confidence}).drop(*(f"_{k}" for k in s))


def signals(text: Column, codes: dict[str, str], most: int = 3) -> Column:
    """The first ``most`` codes of the signals that the lower-cased text contains."""
    low = F.lower(text)
    found = F.filter(F.array(*(F.when(F.contains(low, F.lit(w)), c) for w, c in codes.items())), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(found), 1, most)


def fixed_chunks(text: Column, size: int, least: int) -> Column:
    """Slices of ``size`` characters; none if the trimmed text has at most ``least``."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(F.trim(text)) > least, cut).otherwise(F.array().cast("array<string>"))


def line_groups(text: Column, size: int = 25) -> Column:
    """Groups of ``size`` lines."""
    lines = F.split(text, "\n")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(lines, i * size + 1, F.lit(size)), "\n"))


def numbered(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` (from 1, within the text) with their numbers."""
    lines = F.slice(F.split(text, "\n"), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


_TAGS = ("system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output")
_PREFIXES = (
    "CURRENT TIME:", "VERIFIED FACTS (do not contradict)", "AGENT SPECIALIZATION:", "Checking verified facts...", "Injecting timestamp...",
    "Starting background pipeline...", "Checking emotional weights...", "Auto-save reminder...", "Checking pipeline...", "Alt Memory auto-save checkpoint.",
)
_HOOKS = "Stop|PreCompact|PreToolUse|PostToolUse|UserPromptSubmit|Notification|SessionStart|SessionEnd"
#: Blocks that begin a line and hold no blank line (blank lines are marked first).
BLOCKS = tuple(rf"(?m)^(?:> )?<{t}(?:\s[^>]*)?>[^\x01]*?</{t}>[ \t]*\n?" for t in _TAGS)
#: Status lines, collapsed output, token marks; last the status lines of these tables.
NOISE = (
    rf"(?m)^(?:> )?(?:{'|'.join(re.escape(p) for p in _PREFIXES)}).*\n?",
    rf"(?m)^(?:> )?Ran \d+ (?:{_HOOKS}) hooks?.*\n?",
    r"(?m)^(?:> )?…\s*\+\d+ lines.*\n?",
    r"\s*\[\d+\s+tokens?\]\s*\(ctrl\+o to expand\)",
    r"(?m)^(?:\[hook\]|\[copy\]|Exported by the|>>> ).*$",
)


def without_noise(text: Column) -> Column:
    """Texts without noise and runs of blank lines; null stays null."""
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("")), r"\n(?=\s*\n)", "\n\x01")
    clean = reduce(lambda c, p: F.regexp_replace(c, p, ""), BLOCKS, marked)
    clean = reduce(lambda c, p: F.regexp_replace(c, p, ""), NOISE, F.replace(clean, F.lit("\x01"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(clean, r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def md_entries(text: Column) -> Column:
    """Entries opened by ``## `` or ``# `` headings; text before the first is one of its own."""
    marked = F.regexp_replace(text, r"(?m)^(#{1,2} )", "\x01$1")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def key_sentence(text: Column, most: int = 55) -> Column:
    """The sentence that says most: decision words count 2, short sentences more, long ones less; the first of equals. One longer
    than ``most`` characters ends in three dots."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+"), stripped), lambda s: F.length(s) > 10)
    score = lambda s: 2 * hits(s, M.DECISION_WORDS) + F.when(F.length(s) < 40, 2).when(F.length(s) < 80, 1).when(F.length(s) > 150, -2).otherwise(0)
    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("k"), i.alias("i"), s.alias("s"))))
    best = F.get(F.transform(ranked, lambda r: r["s"]), F.lit(0))
    return F.when(F.length(best) > most, F.concat(F.substring(best, 1, most - 3), F.lit("..."))).otherwise(best)


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * F.lit(1.3)).cast("long")


def content_date(name: Column, text: Column) -> Column:
    """The date of a text: in the file name, else as ``date:`` in front matter, else the first ISO date of the first
    ten lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n")
    iso = r"(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))"
    pick = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    return F.coalesce(pick(name, iso), pick(head, r"(?m)^date: *" + iso), pick(head, iso))


_CHUNK = StructType([StructField("i", IntegerType()), StructField("text", StringType())])


def paragraphs(text: str, least: int = 50, most: int = 2000) -> list[str]:
    """Paragraphs as chunks: short ones join the one before, long ones are cut at lines, long lines at ``most``."""
    out: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if out and len(p) < least and len(out[-1]) + len(p) + 2 <= most:
            out[-1] += "\n\n" + p
            continue
        held = ""
        for line in p.split("\n") if len(p) > most else [p]:
            for piece in (line[k : k + most] for k in range(0, max(1, len(line)), most)):
                if held and len(held) + 1 + len(piece) > most:
                    out.append(held)
                    held = piece
                else:
                    held = f"{held}\n{piece}" if held else piece
        out.append(held)
    return out


@F.pandas_udf(ArrayType(_CHUNK))
def paragraph_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"i": k, "text": p} for k, p in enumerate(paragraphs(t))] if t else [])


def exchanges(text: str) -> list[str]:
    """Turns that open with ``>`` with what follows, up to the next turn or a rule; needs three turns, else paragraphs."""
    lines = text.split("\n")
    if sum(x.startswith(">") for x in lines) < 3:
        return paragraphs(text)
    out: list[list[str]] = []
    for x in lines:
        if x.startswith(">"):
            out.append([x])
        elif x.strip().startswith("---"):
            out.append([])
        elif x.strip() and out and out[-1]:
            out[-1].append(x.strip())
    return ["\n".join([t[0], " ".join(t[1:])]).strip() for t in out if t]


@F.pandas_udf(ArrayType(_CHUNK))
def exchange_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"i": k, "text": p} for k, p in enumerate(exchanges(t))] if t else [])


def comments(source: str) -> list[str]:
    """Comments and docstrings of Python source; of other source the texts behind #, // and --."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [m.strip() for m in re.findall(r"(?m)(?:^|\s)(?:#|//|--)\s+(.+)$", source)]
    docs = [ast.get_docstring(n) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef))]
    try:
        notes = [t.string.lstrip("# ") for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, IndentationError):
        notes = []
    return [x for x in [*docs, *notes] if x]


_SPAN = StructType([StructField("name", StringType()), StructField("type", StringType()), StructField("confidence", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
#: Kinds of names by pattern, with confidence; the surer and longer of overlapping finds stays.
ENTITY_PATTERNS = [
    ("date", "0.90", re.compile(r"\b\d{4}-\d{2}-\d{2}\b")),
    ("project", "0.85", re.compile(r"\b[Pp]roject ([A-Z][a-z]+)\b")),
    ("person", "0.80", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? ([A-Z][\w-]+(?: [A-Z][\w-]+)?)")),
    ("location", "0.75", re.compile(r"\b(?:Lake|Mount|Port|Fort) ([A-Z][a-z]+)\b")),
    ("technology", "0.70", re.compile(r"\b[a-z][\w-]+@\d+(?:\.\d+)+")),
    ("identifier", "0.60", re.compile(r"\b[a-z]+_[a-z_]+\b(?=\()")),
    ("name", "0.40", re.compile(r"(?<=[a-z,;] )[A-Z][a-z]{3,}\b")),
]


def entities_in(text: str) -> list[dict]:
    """Named things in a text without overlaps: by confidence, then length, then place; one find per name."""
    found = [(conf, m.end() - m.start(), -m.start(), kind, m) for kind, conf, p in ENTITY_PATTERNS for m in p.finditer(text)]
    out, taken, names = [], [], set()
    for conf, _, _, kind, m in sorted(found, key=lambda x: (x[0], x[1], x[2]), reverse=True):
        name = m[m.lastindex or 0]
        if name not in names and all(m.end() <= a or b <= m.start() for a, b in taken):
            taken.append(m.span())
            names.add(name)
            out.append({"name": name, "type": kind, "confidence": conf, "start": m.start(), "end": m.end()})
    return sorted(out, key=lambda x: x["start"])


@F.pandas_udf(ArrayType(_SPAN))
def named_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: entities_in(t) if t else [])


def packed(text: str, most: int = 2000) -> list[str]:
    """Lines packed in order into texts of at most ``most`` characters; a longer line stands alone, cut at ``most``."""
    out: list[str] = []
    for line in text.split("\n"):
        for piece in (line[k : k + most] for k in range(0, max(1, len(line)), most)):
            if out and len(out[-1]) + 1 + len(piece) <= most:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


@F.pandas_udf(ArrayType(_CHUNK))
def packed_lines(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"i": k, "text": p} for k, p in enumerate(packed(t))] if t else [])


def sessions(docs: DataFrame, header: str, restored: list[str], least: int) -> DataFrame:
    """(doc_id, session, first_line, lines): the sessions of each text (doc_id, text), which begin at a line that starts with ``header``
    unless one of the marks ``restored`` stands in it or the five lines behind; those of fewer than ``least`` lines are left out, and so is
    what stands before the first. The windows run within one text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    mark = reduce(lambda a, b: a | b, [F.contains("line", F.lit(r)) for r in restored])
    again = F.max(mark.cast("int")).over(w.rowsBetween(0, 5)) > 0
    n = lines.withColumn("opens", F.startswith("line", F.lit(header)) & ~again).withColumn("session", F.sum(F.col("opens").cast("long")).over(w))
    return n.where("session > 0").groupBy("doc_id", "session").agg((F.min("i") + 1).alias("first_line"), F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= least)
