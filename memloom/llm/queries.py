"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from memloom.llm import knn, leak, mix, neardup, pii, quality, split

QUERIES = {
    "p1_found": neardup.p1_found,
    "p1_groups": neardup.p1_groups,
    "p4_found": knn.p4_found,
    "p5_found": split.p5_found,
    "p5_pieces": split.p5_pieces,
    "p6_found": pii.p6_found,
    "p6_redacted": pii.p6_redacted,
    "p6_surrogates": pii.p6_surrogates,
    "p6_pseudonymised": pii.p6_pseudonymised,
    "p7_found": leak.p7_found,
    "p7_report": leak.p7_report,
    "p8_selection": mix.p8_selection,
    "p8_report": mix.p8_report,
    "p9_found": quality.p9_found,
    "p9_stats": quality.p9_stats,
    "p9_profiles": quality.p9_profiles,
}

_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_COMMON = ", ".join(f"'{w}'" for w in quality.COMMON)

SQL: dict[str, str] = {
    "p1_found": f"""
        WITH RECURSIVE e AS (SELECT id, any_value({_W.format("content")}) AS w FROM entities WHERE content IS NOT NULL GROUP BY id),
        s AS (SELECT DISTINCT id, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM e WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        links AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id WHERE a.id <> b.id GROUP BY a.id, b.id, x.n, y.n HAVING count(*) >= 0.6::DOUBLE * (x.n + y.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT DISTINCT a AS id_a, b AS id_b FROM reach WHERE a < b""",
    "p5_found": """
        SELECT DISTINCT 'entities' AS tbl, id FROM entities WHERE length(content) > 2000
        UNION SELECT DISTINCT 'nodes', id FROM nodes WHERE length(content) > 2000""",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM (SELECT doc_id, {_W.format("text")} AS w FROM documents)),
        e AS (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM (SELECT item_id, {_W.format("text")} AS w FROM eval_items))
        SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, list_aggregate(w[i : i + 14], 'string_agg', ' ') AS g FROM d) JOIN (SELECT item_id, list_aggregate(w[i : i + 14], 'string_agg', ' ') AS g FROM e) USING (g)""",
    "p9_stats": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_W.format("coalesce(text, '')")} AS w FROM documents),
        l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda q: trim(q, ' ') <> '') AS lines, len(list_filter(w, lambda q: q IN ({_COMMON}))) AS common FROM t)
        SELECT DISTINCT doc_id, len(w)::BIGINT AS word_count,
          round(CASE WHEN len(w) > 0 THEN length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / len(w) ELSE 0 END, 6) AS mean_word_length,
          round(CASE WHEN length(x) > 0 THEN length(regexp_replace(x, '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))::DOUBLE / length(x) ELSE 0 END, 6) AS symbol_ratio,
          round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda q: regexp_matches(q, '[.!?…。！？]["''”’)\\]» ]*$')))::DOUBLE / len(lines) ELSE 0 END, 6) AS punctuated_lines,
          round(CASE WHEN len(w) > 0 THEN common::DOUBLE / len(w) ELSE 0 END, 6) AS common_words
        FROM l""",
}
SQL["p7_report"] = f"""SELECT item_id, kind, count(*) AS documents FROM ({SQL["p7_found"]}) JOIN eval_items USING (item_id) GROUP BY item_id, kind"""
