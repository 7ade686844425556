"""Files as sources: texts by pattern, chat transcripts as messages, daily notes."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PATTERNS = ("*.txt", "*.md", "*.py", "*.json", "*.yaml", "*.yml", "*.cfg", "*.ini", "*.log")
MESSAGE = "session string, id string, ts string, role string, content string"


def ignore_patterns(lines: list[str]) -> list[tuple[bool, str]]:
    """Ignore rules as (keep, regular expression on a relative path), in order; the last that matches counts."""
    out = []
    for line in lines:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        rooted, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else p for p in _parts(rule.strip("/")))
        out.append((keep, ("^" if rooted else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$")))
    return out


def _parts(rule: str) -> Iterator[str]:
    i = 0
    while i < len(rule):
        if rule[i : i + 3] == "**/":
            yield "(?:.*/)?"
            i += 3
        elif rule[i : i + 2] == "**":
            yield "**"
            i += 2
        elif rule[i] in "*?":
            yield rule[i]
            i += 1
        else:
            yield rule[i] if rule[i].isalnum() or rule[i] in "/_-" else "\\" + rule[i]
            i += 1


def ignored(path: Column, rules: list[str]) -> Column:
    out = F.lit(False)
    for keep, pattern in ignore_patterns(rules):
        out = F.when(path.rlike(pattern), not keep).otherwise(out)
    return out


def text_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS, rules: list[str] | None = None, most_bytes: int = 500_000_000) -> DataFrame:
    """(path, text, modified) of the files below ``root`` whose name fits a pattern, whose path no rule ignores and which
    aren't larger than ``most_bytes``. Bytes are UTF-8, else Windows-1252."""
    names = [fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$") for p in patterns]
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    at = F.substring(path, len(root.rstrip("/")) + 2, 100_000)
    fits = F.lit(False)
    for n in names:
        fits = fits | F.regexp_extract(path, r"[^/]+$", 0).rlike(n)
    b = b.where((F.col("length") <= most_bytes) & fits & ~ignored(at, rules or []))
    return b.select(path.alias("path"), decoded("content").alias("text"), F.col("modificationTime").alias("modified"))


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 where they are valid, else Windows-1252 with marks for what that lacks."""

    def read(b: bytes) -> str:
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return b.decode("cp1252", "replace")

    return content.map(lambda b: None if b is None else read(bytes(b)))


def flattened(content) -> str:
    """A message's content as text: blocks of text, tool calls and tool results by line."""
    if isinstance(content, str):
        return content
    out = []
    for b in content if isinstance(content, list) else []:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "text":
            out.append(str(b.get("text", "")))
        elif kind == "tool_use":
            out.append(f"[tool {b.get('name', '')}] {json.dumps(b.get('input', {}), sort_keys=True)}")
        elif kind == "tool_result":
            out.append(f"[result] {flattened(b.get('content', ''))}")
    return "\n".join(x for x in out if x)


def _agent_lines(text: str) -> list[tuple]:
    out = []
    for line in text.split("\n"):
        try:
            m = json.loads(line)
            body = m["message"]
            row = (m["sessionId"], m["uuid"], m["timestamp"], body["role"], flattened(body["content"]))
        except (ValueError, KeyError, TypeError):
            continue
        if m.get("type") in ("user", "assistant") and row[3] in ("user", "assistant") and all(row):
            out.append(row)
    return out


def _tree(data: dict) -> list[tuple]:
    """A conversation kept as a tree: the path along first children."""
    nodes, out = data.get("mapping", {}), []
    at = next((k for k, n in nodes.items() if n.get("parent") is None), None)
    while at is not None:
        m = nodes[at].get("message")
        role = (m or {}).get("author", {}).get("role")
        text = "\n".join(x for x in (m or {}).get("content", {}).get("parts", []) if isinstance(x, str))
        if role in ("user", "assistant") and text:
            out.append((data.get("id") or data.get("title") or "", at, str(m.get("create_time") or ""), role, text))
        at = next(iter(nodes[at].get("children", [])), None)
    return out


def _flat(data: list, session: str) -> list[tuple]:
    """A list of messages: roles as given, or by turns between the first speaker and the rest."""
    out, first = [], None
    for k, m in enumerate(data):
        who = m.get("role") or m.get("sender") or m.get("user")
        text = flattened(m.get("content") or m.get("text") or "")
        if not who or not text:
            continue
        first = first or who
        role = who if who in ("user", "assistant") else "user" if who in ("human", first) else "assistant"
        out.append((session, str(m.get("id") or k), str(m.get("ts") or m.get("created_at") or ""), role, text))
    return out


def messages_of(path: str, text: str) -> list[tuple]:
    """Messages of a transcript in one of the known formats; none for other texts."""
    if path.endswith(".jsonl"):
        return _agent_lines(text)
    try:
        data = json.loads(text)
    except ValueError:
        return []
    name = path.rsplit("/", 1)[-1]
    if isinstance(data, dict) and "mapping" in data:
        return _tree(data)
    if isinstance(data, dict) and isinstance(data.get("chat_messages"), list):
        return _flat(data["chat_messages"], data.get("uuid") or name)
    return _flat(data, name) if isinstance(data, list) and all(isinstance(m, dict) for m in data) else []


def transcripts(files: DataFrame) -> DataFrame:
    """Messages (session, id, ts, role, content) of transcript files (path, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [m for path, text in zip(p["path"], p["text"], strict=True) for m in messages_of(path, text or "")]
            yield pd.DataFrame(rows, columns=["session", "id", "ts", "role", "content"], dtype=object)

    return files.select("path", "text").mapInPandas(run, MESSAGE)


def as_transcript(messages: DataFrame) -> DataFrame:
    """One text per session: user turns behind ``> ``, in order of time. A session is one document's worth of messages."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.col("content"))).otherwise(F.concat(F.col("content"), F.lit("\n")))
    turns = F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line"))))
    return messages.groupBy("session").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text"))


def daily_notes(files: DataFrame, least: int = 50) -> DataFrame:
    """(path, date, text) of files named by a date, with at least ``least`` characters."""
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*\.md$", 1)
    return files.select("path", date.alias("date"), "text").where((F.col("date") != "") & (F.length("text") >= least))
