"""Mixed timestamp notations brought to one unambiguous day or instant.

Local times meet zone-offset intervals in an as-of join: the intervals of each zone are exploded by
local year, so an equi-join on (zone, year) plus a range condition finds them. The number of matching
intervals is the status of a wall-clock time: one gives the offset directly, two mean an ambiguous
hour (it occurs twice, the first is taken), none means a nonexistent one (it moves forward by the gap,
that is, the offset of the interval before the gap holds). No year is left out: before the table the
first offset holds, and behind it the rules repeat every 400 years, as the calendar does.

Defined results: null, empty and unreadable texts, days and times that do not exist, and precisions
coarser than a day (year, month, quarter) give no row; all-numeric dates need a site that tells their
order; a redelivered record counts once; fractions of a second are cut off.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names in the languages of the corpus, by month.
MONTHS = {
    1: "jan january januar januari janvier enero janeiro января ene jän",
    2: "feb february februar februari février fevrier febrero fevereiro февраля févr fev pebruari",
    3: "mar march märz maerz maret mars marzo março marco марта mär mrz",
    4: "apr april avril abril апреля avr abr",
    5: "may mai mei mayo maio мая",
    6: "jun june juni juin junio junho июня",
    7: "jul july juli juillet julio julho июля juil",
    8: "aug august agustus août aout agosto августа agu ago agt",
    9: "sep september septembre septiembre setembro сентября sept set",
    10: "oct october oktober octobre octubre outubro октября okt out",
    11: "nov november novembre noviembre novembro ноября nop",
    12: "dec december dezember desember décembre decembre diciembre dezembro декабря dez des dic déc",
}
# Abbreviations that the zone database gives only as digits.
EXTRA_ABBREVIATIONS = [("Asia/Singapore", "SGT", 28800), ("Asia/Jakarta", "WIB", 25200), ("Asia/Kolkata", "IST", 19800), ("Asia/Tokyo", "JST", 32400)]
#: Local years of the interval table: before it zones keep their first offset, and its last 400 years repeat for ever.
YEARS, CYCLE = range(1800, 2440), 400
OLDEST = int(datetime(YEARS[0], 1, 1, tzinfo=UTC).timestamp())


@lru_cache(maxsize=64)
def offset_intervals(zone: str) -> list[tuple[int, int, int, str]]:
    """(utc start, utc end, offset, abbreviation) of a zone over YEARS, by bisection of hours; the first reaches back for ever."""
    tz, step = ZoneInfo(zone), timedelta(hours=6)
    at, end = datetime(YEARS[0] - 1, 12, 1, tzinfo=UTC), datetime(YEARS[-1] + 1, 2, 1, tzinfo=UTC)

    def state(t: datetime) -> tuple[int, str]:
        local = t.astimezone(tz)
        return int(local.utcoffset().total_seconds()), local.tzname()

    out, begun, now = [], at, state(at)
    while at < end:
        # zones change a few times a year at most: look every 20 days, then bisect to the second
        then = at + step * 80
        if (new := state(then)) != now:
            low, high = at, then
            while high - low > timedelta(seconds=1):
                mid = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                low, high = (mid, high) if state(mid) == now else (low, mid)
            out.append((int(begun.timestamp()), int(high.timestamp()), *now))
            begun, now, at = high, state(high), high
        else:
            at = then
    out.append((int(begun.timestamp()), int(end.timestamp()), *now))
    return [(-(1 << 50), *out[0][1:]), *out[1:]]


def interval_tables(spark: SparkSession, zones: list[str]) -> tuple[DataFrame, DataFrame]:
    """(zone, year, local_start, local_end, reach_end, offset) and (zone, abbreviation, offset); a few thousand rows a zone at most."""
    spans, names = [], {(z, a): o for z, a, o in EXTRA_ABBREVIATIONS if z in zones}
    for zone in zones:
        found = offset_intervals(zone)
        for i, (start, end, offset, name) in enumerate(found):
            reach = max(end + offset, found[i + 1][0] + found[i + 1][2]) if i + 1 < len(found) else end + offset
            first, last = (datetime.fromtimestamp(max(x, OLDEST), UTC).year for x in (start + offset, reach))
            spans.extend((zone, y, start + offset, end + offset, reach, offset) for y in range(first, last + 1))
            if name[:1] not in "+-":
                names[zone, name] = offset
    return (
        spark.createDataFrame(spans or [("", 0, 0, 0, 0, 0)], "zone string, year int, local_start bigint, local_end bigint, reach_end bigint, offset int"),
        spark.createDataFrame([(z, a, o) for (z, a), o in names.items()] or [("", "", 0)], "zone string, abbreviation string, zone_offset int"),
    )


def _month(name: Column) -> Column:
    pairs = [x for number, names in MONTHS.items() for n in names.split() for x in (F.lit(n), F.lit(number))]
    return F.create_map(*pairs)[F.lower(name)]


# The notations. A day part gives y, m, d in the order named (n: numeric, order by site;
# b: month by name; two-digit years count as 20xx), a time part follows it.
_TIME = r"(?:[T ]\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*(Z|z|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}|[A-Za-z]{2,5})?)?$"
NOTATIONS = [
    ("ymd", r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME),
    ("ymd", r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:T([0-9]{2})([0-9]{2})([0-9]{2})?()(Z|[+-][0-9]{4})?)?$"),
    ("ymd", r"^([0-9]{4})\s?年\s?([0-9]{1,2})\s?月\s?([0-9]{1,2})\s?日" + _TIME),
    ("ymd", r"^D:([0-9]{4})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]{2})([0-9]{2})?()(Z|[+-][0-9]{2}'?[0-9]{2})?'?(?:00'00'?)?)?$"),
    ("nny", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + _TIME),
    ("dby", r"^(?:[^\W\d]+\.?,\s*)?([0-9]{1,2})(?:\.|st|nd|rd|th)?[- ]\s?(?:de )?([^\W\d]+)\.?[- ,]\s?(?:de )?([0-9]{4}|[0-9]{2})" + _TIME),
    ("bdy", r"^(?:[^\W\d]+\.?,\s*)?([^\W\d]+)\.? ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})" + _TIME),
]


def parsed(df: DataFrame, text: str, day_first: str) -> DataFrame:
    """Adds y, mo, d, h, mi, s (integers, checked), zone_text and epoch (seconds, of bare digit instants)."""
    t = F.trim(F.translate(F.col(text), "  　", "   "))
    out = df.withColumn("_t", t)
    # one rewriting per notation puts the parts in one order: notation, three day parts, h, mi, s, am/pm, zone
    line = F.lit(None).cast("string")
    for kind, pattern in reversed(NOTATIONS):
        pattern = "(?U)" + pattern if "\\W" in pattern else pattern
        line = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, kind + "|" + "|".join(f"${i}" for i in range(1, 9)))).otherwise(line)
    # a generator of one row keeps the optimizer from writing the rewriting out at every later use
    out = out.select("*", F.explode(F.array(F.split(line, r"\|", -1))).alias("_p")).withColumn("_o", F.col("_p")[0])
    p = lambda i: F.col("_p")[i + 1]
    number = lambda c: F.expr(f"try_cast({c} AS int)")
    out = out.withColumn("_mon", F.coalesce(_month(F.when(F.col("_o") == "dby", p(1)).when(F.col("_o") == "bdy", p(0)))))
    year_text = F.when(F.col("_o") == "ymd", p(0)).otherwise(p(2))
    out = out.withColumn("_y", F.when(F.length(year_text) == 2, F.concat(F.lit("20"), year_text)).otherwise(year_text))
    for name, i in (("_a", 0), ("_b", 1), ("_c", 2), ("_h", 3), ("_mi", 4), ("_s", 5)):
        out = out.withColumn(name, p(i))
    out = out.select(
        "*", number("_y").alias("y"),
        F.expr(f"CASE _o WHEN 'ymd' THEN try_cast(_b AS int) WHEN 'nny' THEN CASE WHEN {day_first} THEN try_cast(_b AS int) WHEN NOT {day_first} THEN try_cast(_a AS int) END ELSE _mon END").alias("mo"),
        F.expr(f"CASE _o WHEN 'ymd' THEN try_cast(_c AS int) WHEN 'nny' THEN CASE WHEN {day_first} THEN try_cast(_a AS int) WHEN NOT {day_first} THEN try_cast(_b AS int) END WHEN 'dby' THEN try_cast(_a AS int) ELSE try_cast(_b AS int) END").alias("d"),
        F.expr("try_cast(_h AS int)").alias("_h0"), F.expr("try_cast(_mi AS int)").alias("mi"), F.expr("coalesce(try_cast(_s AS int), 0)").alias("s"),
        F.lower(F.regexp_replace(p(6), r"\.", "")).alias("_ap"), p(7).alias("zone_text"),
        F.expr("CASE WHEN _t RLIKE '^[0-9]{10}$' THEN try_cast(_t AS bigint) WHEN _t RLIKE '^[0-9]{13}$' THEN try_cast(_t AS bigint) DIV 1000 END").alias("epoch"),
    )
    numbers = [c for c in ("y", "mo", "d", "_h0", "mi", "s", "_ap")]
    out = out.select(*[c for c in out.columns if c not in numbers], F.explode(F.array(F.struct(*numbers))).alias("_n")).select("*", "_n.*").drop("_n")
    # a twelve-hour clock beyond 12, or a day or time that doesn't exist, gives nothing
    out = out.withColumn("h", F.expr("CASE WHEN _ap IN ('am', 'pm') THEN CASE WHEN _h0 BETWEEN 1 AND 12 THEN _h0 % 12 + CASE _ap WHEN 'pm' THEN 12 ELSE 0 END END ELSE _h0 END"))
    good = "mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y BETWEEN 1 AND 9999 AND (_h0 IS NULL OR (h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59))"
    out = out.select("*", F.explode(F.expr(f"array(CASE WHEN {good} THEN try_to_timestamp(format_string('%04d-%02d-%02d', y, mo, d), 'yyyy-MM-dd') END)")).alias("_day"))
    out = out.withColumn("local", F.expr("CASE WHEN _h0 IS NOT NULL THEN unix_timestamp(_day) + h * 3600 + mi * 60 + s END"))
    out = out.withColumn("day", F.expr("CASE WHEN _h0 IS NULL THEN date_format(_day, 'yyyy-MM-dd') END"))
    return out.drop("_t", "_o", "_p", "_mon", "_y", "_a", "_b", "_c", "_h", "_mi", "_s", "_h0", "_ap", "_day", "h", "mi", "s", "y", "mo", "d")


def resolved(spark: SparkSession, metadata: DataFrame, sites: DataFrame) -> DataFrame:
    """(doc_id, field, iso, status) of each date text of an upload that names a day or an instant.

    status: DAY (no time), EPOCH (digits alone), ZONED (the text states its zone), and of wall-clock times UNIQUE,
    AMBIGUOUS or NONEXISTENT by the number of zone-offset intervals that hold them.
    """
    by_site = sites.select(F.col("site").alias("_site"), "time_zone", "day_first").dropDuplicates(["_site"])
    # the sites are a small fixed dimension; its zones set the size of the interval table
    zones = sorted({r.time_zone for r in by_site.select("time_zone").distinct().collect() if r.time_zone})
    spans, names = interval_tables(spark, zones)
    once = metadata.select("doc_id", "site", F.col("cover_metadata.document_date").alias("document_date"), "cover_date", "creation_date").dropDuplicates(["doc_id"])
    long = once.select("doc_id", "site", F.expr("stack(3, 'document_date', document_date, 'cover_date', cover_date, 'creation_date', creation_date) AS (field, text)")).where("text RLIKE '[0-9]'")
    long = long.join(by_site, F.col("site") == F.col("_site"), "left")
    got = parsed(long, "text", "day_first").where("epoch IS NOT NULL OR local IS NOT NULL OR day IS NOT NULL")
    got = got.join(F.broadcast(names), (F.col("time_zone") == names.zone) & (F.upper("zone_text") == names.abbreviation), "left").drop("zone", "abbreviation")
    digits = F.regexp_replace("zone_text", "[^0-9]", "")
    got = got.withColumn(
        "stated",
        F.when(F.upper("zone_text").isin("Z", "UTC", "GMT"), F.lit(0))
        .when(F.col("zone_text").rlike("^[+-]"), F.expr("try_cast(concat(substr(zone_text, 1, 1), '1') AS int)") * (F.expr("try_cast(left(regexp_replace(zone_text, '[^0-9]', ''), 2) AS int)") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60))
        .otherwise(F.col("zone_offset")),
    )
    got = got.withColumn("wall", F.when(F.col("local").isNotNull() & (F.coalesce(F.col("zone_text"), F.lit("")) == ""), F.col("local")))
    # a time outside of the table is looked up where its year stands in it, whole calendar cycles away
    year, cycle_seconds = F.year(F.timestamp_seconds("wall")), CYCLE * 146097 // 400 * 86400
    cycles = F.greatest(F.lit(0), F.ceil((year - (YEARS[-1] - 1)) / CYCLE)).cast("bigint")
    got = got.withColumn("held", F.col("wall") - cycles * cycle_seconds).withColumn("held_year", F.greatest(F.lit(YEARS[0]), year - cycles * CYCLE))
    hit = (got.time_zone == spans.zone) & (got.held_year == spans.year) & (got.held >= spans.local_start) & (got.held < spans.reach_end)
    # an interval reaches over the gap behind it, but a time in the gap doesn't match it
    placed = got.join(F.broadcast(spans), hit, "left").withColumn("matches", F.col("held") < F.col("local_end"))
    key = ["doc_id", "field", "day", "epoch", "local", "stated", "wall"]
    offset = F.coalesce(F.max(F.when(F.col("matches"), F.col("offset"))), F.max("offset"))
    one = placed.groupBy(*key).agg(offset.alias("wall_offset"), F.count_if("matches").alias("intervals"))
    # of two instants the first is the one with the larger offset
    instant = F.coalesce("epoch", F.col("local") - F.col("stated"), F.col("wall") - F.col("wall_offset"))
    iso = F.coalesce("day", F.date_format(F.timestamp_seconds(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    status = (
        F.when(F.col("day").isNotNull(), "DAY").when(F.col("epoch").isNotNull(), "EPOCH").when(F.col("stated").isNotNull(), "ZONED")
        .when(F.col("intervals") == 0, "NONEXISTENT").when(F.col("intervals") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    )
    return one.select("doc_id", "field", iso.alias("iso"), status.alias("status")).where("iso IS NOT NULL")


def unambiguous(spark: SparkSession, metadata: DataFrame, sites: DataFrame) -> DataFrame:
    """(doc_id, field, iso) of each date text of an upload that names an existing day or instant."""
    return resolved(spark, metadata, sites).select("doc_id", "field", "iso")
