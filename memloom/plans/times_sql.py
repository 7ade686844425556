"""SQL that reads times in mixed notations, for the queries' SQL: another way than ``operators.timestamps`` to the same result.

Values are matched against lists of formats, and local times are resolved by going to UTC and back: a time that comes back changed
was skipped, one that an hour (or half) away shows again occurs twice.
"""

from __future__ import annotations

from memloom.operators.timestamps import ABBREVIATIONS
from memloom.sources.tables import WITH

_CLOCK = ("%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p")
_BY_NAME = ("%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%a, %d %b %Y")


def _list(dates: tuple[str, ...], seps: tuple[str, ...] = (" ", ", ")) -> str:
    timed = [f"{d}{s}{c}" for d in dates for s in seps for c in _CLOCK] + [f"{d}T{c}" for d in dates if d[1] == "Y" for c in _CLOCK[:2]]
    return "[" + ", ".join(f"'{x}'" for x in timed) + "]"


def _dates(dates: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in dates) + "]"


_YMD = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d")
_DMY, _MDY = (tuple(f.replace("/", s) for s in "/.-") for f in ("%d/%m/%Y", "%m/%d/%Y"))
_ABBR = "CASE zone " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"


def readings(values: str, name: str = "rd") -> str:
    """CTEs that end in ``name`` (v, tz, ord, norm, us, is_date): a reading of each distinct value of ``values`` (a query with the
    columns v, tz, ord)."""
    by = "CASE ord WHEN 'DMY' THEN try_strptime(body, {d}) WHEN 'MDY' THEN try_strptime(body, {m}) END"
    when = f"coalesce(try_strptime(body, {_list(_YMD + _BY_NAME)}), try_strptime(body, ['%Y%m%dT%H%M%S']), {by.format(d=_list(_DMY), m=_list(_MDY))})"
    day = f"coalesce(try_strptime(t, {_dates(_YMD + _BY_NAME[:4])}), CASE WHEN length(t) = 8 THEN try_strptime(t, '%Y%m%d') END, {by.replace('body', 't').format(d=_dates(_DMY), m=_dates(_MDY))})"
    return rf"""
    {name}_a AS (SELECT DISTINCT v, tz, ord FROM ({values}) WHERE v IS NOT NULL),
    {name}_b AS (SELECT *, trim(regexp_replace(v, '\s+', ' ', 'g')) AS t, regexp_extract(trim(regexp_replace(v, '\s+', ' ', 'g')),
        '^(.*?(?:\d:\d{{2}}(?::\d{{2}})?|T\d{{6}}))(?:[.,](\d+))?( ?[AaPp][Mm]\b)? ?(Z|z|UTC|GMT|[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}})? ?(?:\[([^\]]+)\]|([A-Za-z]+/[A-Za-z_/]+|[A-Z]{{2,5}}))?$', ['b', 'f', 'h', 'o', 'z1', 'z2']) AS m FROM {name}_a),
    {name}_c AS (SELECT v, tz, ord, t, replace(m.b, 't', 'T') || CASE WHEN m.h <> '' THEN ' ' || upper(trim(m.h)) ELSE '' END AS body, substr(rpad(m.f, 6, '0'), 1, 6)::INT AS us0, m.o AS o, m.z1 || m.z2 AS zone FROM {name}_b),
    {name}_d AS (SELECT *, {day} AS day, CASE WHEN body <> '' THEN {when} END AS clock,
        CASE WHEN regexp_full_match(t, '\d{{10}}(\.\d+)?') THEN substr(t, 1, 10)::BIGINT * 1000000 + substr(rpad(substr(t, 12), 6, '0'), 1, 6)::BIGINT WHEN regexp_full_match(t, '\d{{13}}') THEN t::BIGINT * 1000 WHEN regexp_full_match(t, '\d{{16}}') THEN t::BIGINT END AS epoch,
        CASE WHEN o IN ('Z', 'z', 'UTC', 'GMT') THEN 0 WHEN o <> '' THEN CASE WHEN o[1] = '-' THEN -1 ELSE 1 END * (substr(o, 2, 2)::INT * 60 + coalesce(TRY_CAST(substr(replace(o, ':', ''), 4, 2) AS INT), 0)) ELSE {_ABBR} END AS off,
        coalesce(nullif(zone, ''), tz, 'UTC') AS z FROM {name}_c),
    {name}_e AS (SELECT *, CASE WHEN off IS NULL AND clock IS NOT NULL AND z IN (SELECT name FROM pg_timezone_names()) THEN timezone(z, clock) END AS u FROM {name}_d),
    {name}_f AS (SELECT *, CASE WHEN timezone(z, u) <> clock THEN 'none' WHEN timezone(z, u + INTERVAL 1 HOUR) = clock OR timezone(z, u - INTERVAL 1 HOUR) = clock OR timezone(z, u + INTERVAL 30 MINUTE) = clock OR timezone(z, u - INTERVAL 30 MINUTE) = clock THEN 'ambiguous' END AS odd FROM {name}_e WHERE u IS NOT NULL
        UNION ALL BY NAME SELECT * FROM {name}_e WHERE u IS NULL),
    {name}_g AS (SELECT v, tz, ord, odd, day IS NOT NULL AS is_date, CASE WHEN odd IS NOT NULL THEN NULL ELSE coalesce(epoch_us(day), epoch, CASE WHEN off IS NOT NULL THEN epoch_us(clock) - off::BIGINT * 60000000 + us0 ELSE epoch_us(u) + us0 END) END AS us FROM {name}_f),
    {name} AS (SELECT v, tz, ord, is_date, us, CASE WHEN odd IS NOT NULL THEN odd WHEN us IS NULL THEN 'none' WHEN is_date THEN strftime(make_timestamp(us), '%Y-%m-%d') ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') END AS norm FROM {name}_g)"""


ADAPTERS = "ad AS (SELECT adapter_name, min(tz) AS tz, min(date_order) AS ord FROM adapters GROUP BY 1)"

FACT_VALUES = "SELECT valid_from AS v, tz, ord FROM facts LEFT JOIN ad USING (adapter_name) UNION SELECT valid_to, tz, ord FROM facts LEFT JOIN ad USING (adapter_name)"
ENTITY_VALUES = "SELECT created_at AS v, tz, ord FROM entities e LEFT JOIN ad ON ad.adapter_name = json_extract_string(e.metadata, '$.added_by')"
MATCH = "{r}.v = {v} AND {r}.tz IS NOT DISTINCT FROM {a}.tz AND {r}.ord IS NOT DISTINCT FROM {a}.ord"

#: Opens a WITH clause like ``sources.tables.WITH``, with ``ents`` that also have the norm and us of created_at.
TIMED = f"""{WITH}, {ADAPTERS}, {readings(ENTITY_VALUES)},
    tents AS (SELECT ents.*, rd.us, rd.norm FROM ents LEFT JOIN ad ON ad.adapter_name = json_extract_string(ents.metadata, '$.added_by') LEFT JOIN rd ON {MATCH.format(r='rd', v='ents.created_at', a='ad')})"""

P3 = rf"""WITH {ADAPTERS}, x AS (SELECT 'facts' AS tbl, id::VARCHAR AS id, adapter_name AS by_, unnest(['valid_from', 'valid_to']) AS field, unnest([valid_from, valid_to]) AS v FROM facts
    UNION ALL SELECT 'entities', id, json_extract_string(metadata, '$.added_by'), 'created_at', created_at FROM entities),
    y AS (SELECT x.*, tz, ord FROM x LEFT JOIN ad ON ad.adapter_name = x.by_ WHERE v <> ''), {readings('SELECT v, tz, ord FROM y')}
    SELECT DISTINCT tbl, id, field, norm FROM y JOIN rd ON {MATCH.format(r='rd', v='y.v', a='y')}
    WHERE NOT (regexp_full_match(y.v, '\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}}Z)?') AND norm <> 'none')"""

_EVEN = "replace(replace(lower({0}), ' ', '_'), '''', '')"
_TEXT = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%fZ')"
#: Versions by going through each key's rows in order of start.
P2 = f"""WITH {ADAPTERS}, {readings(FACT_VALUES)},
    f AS (SELECT facts.id, {_EVEN.format('subject')} AS subject, replace(lower(facts.predicate), ' ', '_') AS predicate, {_EVEN.format('object')} AS object, b.us AS start, CASE WHEN e.is_date THEN e.us + 86399000000 ELSE e.us END AS stop
        FROM facts LEFT JOIN ad USING (adapter_name) JOIN rd b ON {MATCH.format(r='b', v='facts.valid_from', a='ad')} LEFT JOIN rd e ON {MATCH.format(r='e', v='facts.valid_to', a='ad')}
        WHERE b.us IS NOT NULL AND replace(lower(facts.predicate), ' ', '_') IN (SELECT predicate FROM predicates WHERE single_valued)),
    one AS (SELECT subject, predicate, start, max(id) AS id, arg_max(object, id) AS object, arg_max(coalesce(stop, 9000000000000000000), id) AS stop FROM f WHERE subject IS NOT NULL AND object IS NOT NULL AND (stop IS NULL OR stop >= start) GROUP BY ALL),
    g AS (SELECT *, CASE WHEN lag(object) OVER w = object AND lag(stop) OVER w >= start - 1000000 THEN 0 ELSE 1 END AS new FROM one WINDOW w AS (PARTITION BY subject, predicate ORDER BY start)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY subject, predicate ORDER BY start) AS k FROM g),
    v AS (SELECT subject, predicate, k, any_value(object) AS object, min(start) AS start, arg_max(stop, start) AS stop FROM n GROUP BY ALL),
    c AS (SELECT *, lead(start) OVER (PARTITION BY subject, predicate ORDER BY start) AS follows FROM v)
    SELECT DISTINCT subject, predicate, object, {_TEXT.format('start')} AS starts, CASE WHEN least(stop, coalesce(follows, stop)) < 9000000000000000000 THEN {_TEXT.format('least(stop, coalesce(follows, stop))')} ELSE '' END AS ends FROM c"""
