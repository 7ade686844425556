"""Times in many notations brought to one UTC form.

The notation is read by one regular expression per value in the JVM. A value without an offset names a local
time of a zone; it is resolved by an as-of join against the zone's offset intervals on the local time axis:
two matching intervals mean that the clock showed this time twice (``ambiguous``), none that it skipped it
(``none``), one gives the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import small, table, written

_DATE = (
    r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"  # 1 year, 3 month, 4 day
    r"|(\d{4})(\d{2})(\d{2})"  # 5 6 7
    r"|(\d{1,2})([-/.])(\d{1,2})\9(\d{4})"  # 8 first, 10 second, 11 year
    r"|(\d{1,2})(?:st|nd|rd|th)?\.?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})"  # 12 day, 13 month name, 14 year
    r"|([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}))"  # 15 month name, 16 day, 17 year
)
_TIME = r"(?:(?:[Tt]|,?\s+)(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?)?"  # 18 to 22
_ZONE = (
    r"\s*(Z|z|UTC|utc|GMT|gmt|(?:UTC|GMT)?[+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})?"  # 23
    r"\s*(?:\[([A-Za-z0-9_+/-]+)\]|([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+|[A-Z]{2,5}))?"  # 24 25
)
NOTATION = r"^(?:[A-Za-z]{3,9},?\s+)?" + _DATE + _TIME + _ZONE + "$"
#: Fields in the order in which PARTS has them.
PARTS = ("y", "m", "d", "name", "a", "b", "by", "h", "mi", "s", "frac", "half", "off", "zone")
_TO = "\x02|$1$5$14$17|$3$6|$4$7$12$16|$13$15|$8|$10|$11|$18|$19|$20|$21|$22|$23|$24$25"
#: Abbreviated zones as the offsets they stand for at any time of the year, in minutes (fixed values). Of those with several
#: meanings EST to PDT are the North American ones, IST is India's and BST Britain's.
ABBREVIATIONS = {
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parsed(df: DataFrame, value: str, order: str, at: str = "") -> DataFrame:
    """Adds ``_day`` (days since 1970), ``_sec`` (seconds of the day, null for a pure date), ``_us``, ``_off``
    (offset in seconds, of an abbreviated zone too, null if the value has none), ``_zone`` (null if the value names none), ``_abs``
    (microseconds since 1970 where the value is a number); all null if the value isn't a time.

    ``order`` names the column with YMD, DMY or MDY for all-number dates that don't begin with the year; under
    YMD (or null) such a date can't be read and counts as no time. ``at`` is put behind the names of the new columns.
    """
    keep = df.columns
    t = F.trim(F.regexp_replace(F.col(value), r"[\s ]+", " "))
    df = df.withColumn("_t", t).withColumn("_p", F.split(F.regexp_replace("_t", NOTATION, _TO), r"\|"))
    hit = F.startswith("_t", F.lit("\x02")) | (F.size("_p") != len(PARTS) + 1)
    get = lambda k: F.when(~hit & (F.element_at("_p", 1) == "\x02"), F.element_at("_p", PARTS.index(k) + 2))
    df = df.select("*", *(get(k).alias(f"_{k}") for k in PARTS))
    name = F.lower("_name")
    by_name = F.when(name.rlike(f"^({MONTHS})$"), ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(name, 1, 3)) + 2) / 3).cast("int"))
    dmy, mdy = F.col(order) == "DMY", F.col(order) == "MDY"
    swap = F.col("_by") != ""
    df = df.select(
        "*",
        _int(F.when(swap, F.col("_by")).otherwise(F.col("_y"))).alias("_yy"),
        F.when(swap, F.when(dmy, _int(F.col("_b"))).when(mdy, _int(F.col("_a")))).when(F.col("_name") != "", by_name).otherwise(_int(F.col("_m"))).alias("_mm"),
        F.when(swap, F.when(dmy, _int(F.col("_a"))).when(mdy, _int(F.col("_b")))).otherwise(_int(F.col("_d"))).alias("_dd"),
        _int(F.col("_h")).alias("_hh"),
        F.coalesce(_int(F.col("_mi")), F.lit(0)).alias("_min"),
        F.coalesce(_int(F.col("_s")), F.lit(0)).alias("_ss"),
        F.rpad(F.substring("_frac", 1, 6), 6, "0").cast("int").alias("_us0"),
    )
    y, m, d, h = (F.col(f"_{k}") for k in ("yy", "mm", "dd", "hh"))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest)
    has_time = F.col("_h") != ""
    half = F.lower("_half")
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    good_time = hour.between(0, 23) & (F.col("_min") < 60) & (F.col("_ss") < 60)
    sign = F.when(F.col("_off").contains("-"), -1).otherwise(1)
    digits = F.regexp_replace("_off", r"[^0-9]", "")
    part = lambda k: F.coalesce(_int(F.substring(digits, k, 2)), F.lit(0))
    named = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', {v * 60}" for k, v in ABBREVIATIONS.items()) + ")"), F.col("_zone"))
    off = F.when(F.col("_off") == "", named).when(digits == "", 0).when((part(1) <= 18) & (part(3) < 60), sign * (part(1) * 3600 + part(3) * 60 + part(5))).otherwise(99999)
    ok = F.coalesce(good & (~has_time | good_time) & (has_time | (F.col("_off") == "") & (F.col("_zone") == "")) & F.coalesce(off != 99999, F.lit(True)), F.lit(False))
    number = F.col("_t").rlike(r"^(\d{10}(\.\d+)?|\d{13}|\d{16})$")
    whole, tail = F.regexp_extract("_t", r"^(\d+)", 1), F.regexp_extract("_t", r"\.(\d+)$", 1)
    epoch = F.when(number, F.rpad(whole, 16, "0").cast("long") + F.when(tail != "", F.rpad(F.substring(tail, 1, 6), 6, "0").cast("long")).otherwise(0))
    out = {
        "_day": F.when(ok, F.unix_date(F.make_date(y, m, d))),
        "_sec": F.when(ok & has_time, hour * 3600 + F.col("_min") * 60 + F.col("_ss")),
        "_us": F.when(ok & has_time, F.when(F.col("_frac") != "", F.col("_us0")).otherwise(0)),
        "_off": F.when(ok, off),
        "_zone": F.when(ok & (F.col("_zone") != ""), F.col("_zone")),
        "_abs": epoch,
        "_year": F.when(ok, y),
    }
    return df.select(*keep, *(c.alias(k + at) for k, c in out.items()))


def offset_intervals(pairs: DataFrame) -> DataFrame:
    """For each (zone, year) the intervals of equal offset on the local time axis, packed into one row:
    ``spans`` ARRAY<STRUCT<lo, hi, off>>, seconds since 1970 as the local clock shows them. ``zone`` must hold
    known zone names only."""
    at = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), F.col("zone"))) - s
    day0 = F.unix_date(F.make_date("year", F.lit(1), F.lit(1))).cast("long") - 2
    day1 = F.unix_date(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))).cast("long") + 2
    days = pairs.select("zone", "year", (day0 * 86400).alias("from"), (day1 * 86400).alias("to"), F.explode(F.sequence(day0, day1 - 1)).alias("day"))
    changed = days.where(at(F.col("day") * 86400) != at((F.col("day") + 1) * 86400))
    minutes = changed.select("zone", "year", F.explode(F.sequence(F.col("day") * 86400 + 60, (F.col("day") + 1) * 86400, F.lit(60).cast("long"))).alias("u"))
    turns = minutes.where(at(F.col("u")) != at(F.col("u") - 60)).groupBy("zone", "year").agg(F.array_sort(F.collect_set("u")).alias("turns"))
    spans = pairs.select("zone", "year", (day0 * 86400).alias("from"), (day1 * 86400).alias("to")).join(turns, ["zone", "year"], "left")
    edges = F.concat(F.array("from"), F.coalesce("turns", F.array().cast("array<bigint>")), F.array("to"))
    spans = spans.withColumn("edges", edges).select("zone", "year", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("i", "u0"), "edges")
    spans = spans.withColumn("u1", F.element_at("edges", F.col("i") + 2)).withColumn("off", at(F.col("u0")))
    return spans.groupBy("zone", "year").agg(F.collect_list(F.struct((F.col("u0") + F.col("off")).alias("lo"), (F.col("u1") + F.col("off")).alias("hi"), F.col("off").alias("off"))).alias("spans"))


def normalised(df: DataFrame, value: str, zone: str, order: str) -> DataFrame:
    """Adds ``norm``, ``us`` and ``is_date`` for the text column ``value``.

    ``norm`` is ``2024-05-06T07:08:09.123456Z``, ``2024-05-06`` for a pure date (no zone applied), ``ambiguous``,
    ``none``, or null for a null value. ``us`` is the time in microseconds since 1970 (a date's midnight), null
    unless the time is known. ``zone`` and ``order`` name columns with the zone and the order of all-number dates
    for values that carry none; nulls there mean UTC and YMD. An abbreviated zone is a fixed offset
    (``ABBREVIATIONS``), any other unknown zone name makes a value ``none``. Empty text is ``none``. Columns of
    ``df`` must not begin with ``_``.
    """
    out = normalised_all(df, [value], zone, order)
    return out.withColumnsRenamed({f"{value}_{k}": k for k in ("norm", "us", "is_date")})


def _holding(at: Column):
    """Whether an interval holds ``at``."""
    return lambda s: (s["lo"] <= at) & (at < s["hi"])


def normalised_all(df: DataFrame, values: list[str], zone: str, order: str) -> DataFrame:
    """The same for several columns in one pass: adds ``v_norm``, ``v_us`` and ``v_is_date`` for each v of ``values``."""
    spark = df.sparkSession
    known = ", ".join(f"'{z.strip()}'" for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString()[1:-1].split(","))
    p = df
    for i, value in enumerate(values):
        p = parsed(p, value, order, f"_v{i}")
        local = F.col(f"_sec_v{i}").isNotNull() & F.col(f"_off_v{i}").isNull()
        zone_of = F.coalesce(F.col(f"_zone_v{i}"), F.col(zone), F.lit("UTC"))
        p = p.withColumns({f"_z_v{i}": F.when(local, zone_of), f"_local_v{i}": F.when(local, F.col(f"_day_v{i}").cast("long") * 86400 + F.col(f"_sec_v{i}"))})
    p = written(p)  # read twice below: each value is parsed once
    each = F.explode(F.array(*(F.struct(F.col(f"_z_v{i}").alias("zone"), F.col(f"_year_v{i}").alias("year")) for i in range(len(values)))))
    pairs = p.select(each.alias("p")).select("p.*").where(f"zone IN ({known})").distinct()
    spans = small(written(offset_intervals(pairs)))
    for i, value in enumerate(values):
        own = spans.select(F.col("zone").alias("_jz"), F.col("year").alias("_jy"), F.col("spans").alias("_spans"))
        p = p.join(own, (F.col(f"_z_v{i}") == F.col("_jz")) & (F.col(f"_year_v{i}") == F.col("_jy")), "left")
        at = F.col(f"_local_v{i}")
        p = p.withColumn("_m", F.filter("_spans", _holding(at)))
        n = F.when(F.col(f"_z_v{i}").isNotNull(), F.greatest(F.coalesce(F.size("_m"), F.lit(0)), F.lit(0)))
        off = F.coalesce(F.col(f"_off_v{i}").cast("long"), F.when(n == 1, F.col("_m")[0]["off"]))
        second = F.col(f"_day_v{i}").cast("long") * 86400 + F.coalesce(F.col(f"_sec_v{i}"), F.lit(0))
        is_date = F.col(f"_day_v{i}").isNotNull() & F.col(f"_sec_v{i}").isNull()
        us = F.coalesce(F.col(f"_abs_v{i}"), F.when(is_date, second * 1000000), (second - off) * 1000000 + F.col(f"_us_v{i}"))
        p = p.withColumns({"_u": us, "_n": n})
        text = F.when(is_date, F.substring(us_text(F.col("_u")), 1, 10)).otherwise(us_text(F.col("_u")))
        norm = F.when(F.col(value).isNull(), None).when(F.col("_n") > 1, "ambiguous").when(F.col("_u").isNull(), "none").otherwise(text)
        known_time = F.col("_u").isNotNull()
        p = p.withColumns({f"{value}_norm": norm, f"{value}_us": F.when(known_time, F.col("_u")), f"{value}_is_date": F.when(known_time, is_date)})
        p = p.drop("_jz", "_jy", "_spans", "_m", "_u", "_n")
    return p.select(*df.columns, *(f"{v}_{k}" for v in values for k in ("norm", "us", "is_date")))


def us_text(us: Column) -> Column:
    """Microseconds since 1970 as ``2024-05-06T07:08:09.123456Z``."""
    day = F.date_from_unix_date(F.floor(us / F.lit(86400000000)).cast("int")).cast("string")
    rest = F.pmod(us, F.lit(86400000000))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600000000)), F.lit(":"), two(F.floor(rest / 60000000) % 60), F.lit(":"), two(F.floor(rest / 1000000) % 60), F.lit("."), F.lpad((rest % 1000000).cast("string"), 6, "0"), F.lit("Z"))


def adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per adapter name: ``adapter_name``, ``tz``, ``date_order``."""
    return table(spark, sf_dir, "adapters").groupBy("adapter_name").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))


def created(df: DataFrame, adapters: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the entities ``df`` with ``norm``, ``us`` and ``is_date`` of created_at; the adapter that added an entity
    gives zone and order. ``adapters``: adapter_name, tz, date_order."""
    rows = df.select(*columns, F.col("created_at").alias("at"), F.get_json_object("metadata", "$.added_by").alias("adapter_name")).join(adapters, "adapter_name", "left")
    return normalised(rows, "at", "tz", "date_order").select(*columns, "norm", "us", "is_date")


def time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text time of facts and entities: (tbl, id, field, value, tz, date_order)."""
    f = table(spark, sf_dir, "facts")
    f = f.select(F.lit("facts").alias("tbl"), F.col("id").cast("string").alias("id"), F.col("adapter_name").alias("by"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("valid_from", "valid_to")))).alias("v")).select("tbl", "id", "by", "v.field", "v.value")
    e = table(spark, sf_dir, "entities").select(F.lit("entities").alias("tbl"), "id", F.get_json_object("metadata", "$.added_by").alias("by"), F.lit("created_at").alias("field"), F.col("created_at").alias("value"))
    rows = f.unionByName(e)
    a = adapters(spark, sf_dir)
    return rows.join(a, rows["by"] == a["adapter_name"], "left").select("tbl", "id", "field", "value", "tz", "date_order")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text time that isn't in one of the two standard forms, with its UTC form, ``ambiguous`` or ``none``."""
    v = time_values(spark, sf_dir).where(F.col("value").isNotNull() & (F.col("value") != ""))
    n = normalised(v, "value", "tz", "date_order")
    standard = (F.length("value") == 10) & F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return n.where(~(standard & (F.col("norm") != "none"))).select("tbl", "id", "field", "norm").distinct()
