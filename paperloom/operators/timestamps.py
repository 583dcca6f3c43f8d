"""Mixed timestamp formats and time zones to one UTC instant (problem 2).

Values are read by a fixed list of formats into a local second and a zone.  Offsets and zone
abbreviations carry their offset; a local time in a named zone is looked up, as of its local second,
in the zone-offset intervals of the IANA database, exploded to calendar years so that the lookup is
an equality join: two matching intervals mean the local time is ambiguous (the first instant is
taken), none means it does not exist (it moves forward by the gap), one gives the offset directly.

Defined results: null, blank and unreadable values and impossible days give status ``unreadable``
and no instant; a date without time is midnight UTC; a time without zone uses the zone of the row's
project, UTC if that is unknown; before 1900 and after 2200 the nearest known offset holds;
repeated rows come out as often as they went in; extra columns are kept, except that utc_second and
status are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import boxed, unboxed

FIRST_YEAR, LAST_YEAR = 1900, 2200

#: Offsets in seconds of zone abbreviations, as people write them.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "cet": 3600, "cest": 7200, "est": -18000, "edt": -14400,
    "pst": -28800, "pdt": -25200, "jst": 32400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600,
    "bst": 3600, "west": 3600, "eet": 7200, "eest": 10800, "msk": 10800, "ist": 19800, "aest": 36000, "aedt": 39600,
}

#: English month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_MONTH = r"(?:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\.?)"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_REST = (
    r"(?:(?:t|,?\s+)(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(\d{2})(\d{2})?(?:[.,]\d+)?)(?:\s*([ap])\.?m(?![a-z])\.?)?"
    r"\s*(z|[a-z]{2,5}|(?:utc|gmt)?[+\-\x{2212}]\d{1,2}(?::?\d{2})?|\[?[a-z_]+(?:/[a-z0-9_+\-]+)+\]?|\[(?:utc|gmt|z)\])?)?"
)
#: name -> (pattern, group of year, of month, of day); the groups of _REST follow the date's.
_DATES = {
    "ymd": (r"(\d{4})([\-/.])(\d{1,2})\2(\d{1,2})", 4, (1, 3, 4)),
    "compact": (r"(\d{4})(\d{2})(\d{2})", 3, (1, 2, 3)),
    "mdy": (r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, (3, 1, 2)),
    "dmy": (r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})", 3, (3, 2, 1)),
    "day_month": (_DAY + r"(\d{1,2})(?:st|nd|rd|th|\.)?[\s\-]+(?:of\s+)?" + _MONTH + r"[\s,\-]+(\d{4})", 3, (3, 2, 1)),
    "month_day": (_DAY + _MONTH + r"[\s\-]+(\d{1,2})(?:st|nd|rd|th)?,?[\s\-]+(\d{4})", 3, (3, 1, 2)),
    "week": (r"(\d{4})-?w(\d{2})-?([1-7])", 3, (1, 2, 3)),
    "ordinal": (r"(\d{4})-?(\d{3})", 2, (1, 2, 2)),
}


def _settled(df: DataFrame, columns: dict[str, F.Column]) -> DataFrame:
    """Adds computed columns through a generator of one row, so the optimiser neither repeats their
    expressions in later steps nor pushes filters into them (the generated code stays small)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _int(value: F.Column) -> F.Column:
    return F.when(value != "", value).try_cast("int")


def _day_number(kind: str, y: F.Column, m: F.Column, d: F.Column) -> F.Column:
    """Days since 1970-01-01, null where the day does not exist."""
    first = F.make_date(F.when((y >= 1) & (y <= 9999), y), F.lit(1), F.lit(1))
    if kind == "ordinal":
        length = F.dayofyear(F.make_date(F.when((y >= 1) & (y <= 9999), y), F.lit(12), F.lit(31)))
        return F.when((d >= 1) & (d <= length), F.unix_date(first) + d - 1)
    if kind == "week":
        fourth = F.make_date(F.when((y >= 1) & (y <= 9999), y), F.lit(1), F.lit(4))
        monday = F.unix_date(fourth) - F.weekday(fourth)
        after = F.make_date(F.when((y >= 1) & (y < 9999), y + 1), F.lit(1), F.lit(4))
        weeks = (F.unix_date(after) - F.weekday(after) - monday) / 7
        return F.when((m >= 1) & (m <= weeks), monday + (m - 1) * 7 + d - 1)
    sound = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    month = F.make_date(F.when(sound, y), F.when(sound, m), F.lit(1))
    return F.when(d <= F.dayofmonth(F.last_day(month)), F.unix_date(month) + d - 1)


def parse_local(df: DataFrame, value: str) -> DataFrame:
    """Adds _local (local second), _zone (name, '' = project's zone) and _offset (seconds, if stated).

    Each format rewrites the text to one canonical list of parts, ``kind|y|m|d|h|m|s|m|s|a or p|zone``,
    so every later step reads array elements and no regular expression runs twice.
    """
    edge = r"[\s\x{a0}\x{feff}\"'`\x{2018}\x{2019}\x{201c}\x{201d}\x{201e}\x{ab}\x{bb}]+"
    text = F.lower(F.regexp_replace(F.col(value), f"^{edge}|{edge}$", ""))
    df = _settled(df, {"_text": text})
    t = F.col("_text")
    parts = F.when(t.rlike(r"^-?\d{10,}(?:[.,]\d*)?$"), F.concat(F.lit("unix|"), F.regexp_extract(t, r"^(-?\d+)", 1)))
    for name, (pattern, groups, order) in _DATES.items():
        whole = f"^{pattern}{_REST}$"
        refs = "|".join(f"${g}" for g in (*order, *range(groups + 1, groups + 8)))
        parts = parts.when(t.rlike(whole), F.regexp_replace(t, whole, f"{name}|{refs}|"))
    df = _settled(df, {"_parts": F.split(parts, r"\|")}).drop("_text")
    at = lambda n: F.get("_parts", F.lit(n))
    kind = at(0)
    unix = kind == "unix"
    month = F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), at(2)).cast("int"), F.lit(0))
    df = _settled(
        df,
        {
            "_y": _int(F.when(~unix, at(1))),
            "_mo": F.when(kind.contains("month"), month).otherwise(_int(at(2))),
            "_d": _int(at(3)),
            "_h": _int(at(4)),
            "_m": F.coalesce(_int(at(5)), _int(at(7)), F.lit(0)),
            "_s": F.coalesce(_int(at(6)), _int(at(8)), F.lit(0)),
            "_zone_text": F.regexp_replace(F.regexp_replace(at(10), r"[\[\]]", ""), r"\x{2212}", "-"),
        },
    )
    y, m, d = F.col("_y"), F.col("_mo"), F.col("_d")
    day = (
        F.when(kind == "ordinal", _day_number("ordinal", y, m, d))
        .when(kind == "week", _day_number("week", y, m, d))
        .when(~unix, _day_number("date", y, m, d))
    )
    timed, half, hour = at(4) != "", at(9), F.col("_h")
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    df = _settled(df, {"_day": day, "_hour": hour, "_timed": timed})
    hour = F.col("_hour")
    right = ((hour <= 23) | ((hour == 24) & (F.col("_m") == 0) & (F.col("_s") == 0))) & (F.col("_m") <= 59) & (F.col("_s") <= 60)
    clock = F.when(~F.col("_timed"), 0).when(right, hour * 3600 + F.col("_m") * 60 + F.col("_s"))
    number = F.when(unix, at(1)).try_cast("decimal(38,0)")
    size = F.length(F.regexp_replace(at(1), "-", ""))
    scale = F.when(size >= 18, 10**9).when(size >= 15, 10**6).when(size >= 12, 1000).otherwise(1)
    second = F.floor(number / scale).try_cast("long")
    zone = F.col("_zone_text")
    sign = F.regexp_replace(zone, r"^(?:utc|gmt)?([+\-])(\d\d?):?(\d\d)?$", "$1|$2|$3|")
    signed = F.when(sign.contains("|"), F.split(sign, r"\|"))
    stated = (F.coalesce(_int(signed[1]), F.lit(0)) * 3600 + F.coalesce(_int(signed[2]), F.lit(0)) * 60) * F.when(
        signed[0] == "-", -1
    ).when(signed[0] == "+", 1)
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    word = zone.rlike("^[a-z]+$")
    known = F.when(word, F.try_element_at(names, zone))
    local = F.when(unix, second).when(~F.coalesce(word, F.lit(False)) | known.isNotNull(), F.col("_day").cast("long") * 86400 + clock)
    return _settled(
        df,
        {
            "_local": local,
            "_offset": F.when(unix | ~F.col("_timed"), 0).otherwise(F.coalesce(stated, known)),
            "_zone": F.when(zone.contains("/"), zone).otherwise(""),
        },
    ).drop("_parts", "_y", "_mo", "_d", "_h", "_hour", "_m", "_s", "_day", "_timed", "_zone_text")


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone_key, year, local_from, local_to, n_matching, offset) of each zone name in ``zones``.

    The offset intervals of a zone are laid on the local time line, cut where they begin and end, and
    each piece is labelled with the number of intervals that cover it: 1 = unique, 2 = ambiguous
    (offset of the first instant), 0 = nonexistent (offset before the gap).  Pieces are exploded to
    the years they touch.  Size: at most about 600 zone names exist, 301 years, some 3 pieces a year.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["zone_key"]:
                rows = _pieces(name)
                if rows:
                    yield pd.DataFrame(rows, columns=["zone_key", "year", "local_from", "local_to", "n_matching", "offset"])

    return zones.select("zone_key").mapInPandas(
        build, "zone_key string, year int, local_from long, local_to long, n_matching int, offset int"
    )


@functools.cache
def _zone_names() -> dict[str, str]:
    import zoneinfo

    return {z.lower(): z for z in zoneinfo.available_timezones()}


def _pieces(key: str) -> list[tuple]:
    import datetime as dt
    import zoneinfo

    if (key or "").lower() not in _zone_names():
        return []
    zone, utc = zoneinfo.ZoneInfo(_zone_names()[key.lower()]), dt.timezone.utc

    def offset(second: int) -> int:
        at = dt.datetime(1970, 1, 1, tzinfo=utc) + dt.timedelta(seconds=second)
        return int(at.astimezone(zone).utcoffset().total_seconds())

    begin = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc) - dt.datetime(1970, 1, 1, tzinfo=utc)).total_seconds())
    end = int((dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=utc) - dt.datetime(1970, 1, 1, tzinfo=utc)).total_seconds())
    step, at, now, spans = 7 * 86400, begin, offset(begin), []
    since = -(10**15)
    while at < end:
        then = offset(at + step)
        if then != now:
            low, high = at, at + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == now else (low, middle)
            spans.append((since, high, now))
            since, now, at = high, offset(high), high
        else:
            at += step
    spans.append((since, 10**15, now))
    local = [(a + o, b + o, o) for a, b, o in spans]
    cuts = sorted({x for a, b, _ in local for x in (a, b)})
    out, k = [], 0
    first = {y: (dt.datetime(y, 1, 1) - dt.datetime(1970, 1, 1)).days * 86400 for y in range(FIRST_YEAR, LAST_YEAR + 1)}
    year = lambda s: min(max((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=min(max(s, first[FIRST_YEAR]), first[LAST_YEAR]))).year, FIRST_YEAR), LAST_YEAR)
    for a, b in zip(cuts, cuts[1:]):
        while k + 1 < len(local) and local[k][1] <= a and local[k + 1][0] <= a:
            k += 1
        covering = [o for s, e, o in local[max(0, k - 2) : k + 3] if s <= a and b <= e]
        chosen = max(covering) if covering else max((e, o) for _, e, o in local if e <= a)[1]
        out += [(key, y, a, b, len(covering), chosen) for y in range(year(a), year(b - 1) + 1)]
    return out


def normalise(df: DataFrame, value: str, project: str, zones: DataFrame) -> DataFrame:
    """Adds utc_second and status (exact, zoned, ambiguous, nonexistent, unreadable) to ``df``.

    ``project`` names the column that holds the row's project; ``zones`` is (project, time_zone), a
    small fixed table.  No row is shuffled: both lookups are broadcasts whose size is bounded by the
    number of projects and by the IANA database, so a hot project or zone cannot skew anything.
    """
    home = zones.groupBy(F.col("project").alias("_project")).agg(F.min(F.lower(F.trim("time_zone"))).alias("_home"))
    parsed = parse_local(boxed(df, _value=F.col(value), _project=F.col(project)), "_value")
    parsed = parsed.join(F.broadcast(home), "_project", "left").withColumn(
        "_zone_key",
        F.when(F.col("_offset").isNull() & F.col("_local").isNotNull(),
               F.when(F.col("_zone") != "", F.col("_zone")).otherwise(F.coalesce("_home", F.lit("utc")))),
    )
    named = df.select(F.lower(F.regexp_extract(value, r"([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)", 1)).alias("zone_key"))
    used = named.union(home.select("_home")).union(df.sparkSession.createDataFrame([("utc",)], "zone_key string"))
    pieces = zone_intervals(used.filter("zone_key <> ''").distinct().coalesce(4))
    local_year = F.year(F.timestamp_seconds(F.col("_local")))
    parsed = parsed.withColumn("_year", F.least(F.greatest(local_year, F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))
    found = parsed.join(
        F.broadcast(pieces),
        (F.col("_zone_key") == F.col("zone_key")) & (F.col("_year") == F.col("year"))
        & (F.col("_local") >= F.col("local_from")) & (F.col("_local") < F.col("local_to")),
        "left",
    )
    status = (
        F.when(F.col("_local").isNull() | (F.col("_offset").isNull() & F.col("offset").isNull()), "unreadable")
        .when(F.col("_offset").isNotNull(), "exact")
        .when(F.col("n_matching") == 2, "ambiguous")
        .when(F.col("n_matching") == 0, "nonexistent")
        .otherwise("zoned")
    )
    second = F.col("_local") - F.coalesce("_offset", "offset")
    return unboxed(found, df, utc_second=second, status=status)


def metadata_dates(governance: DataFrame, research: DataFrame, zones: DataFrame) -> DataFrame:
    """(node_id, field, value, utc_second, status) of the four dated fields, one row per input row and field."""

    def long(df: DataFrame, fields: list[str]) -> DataFrame:
        return df.select(
            "node_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")
        ).select("node_id", "x.field", "x.value")

    rows = long(governance, ["review_due", "effective_date"]).unionByName(long(research, ["last_verified", "valid_until"]))
    rows = rows.withColumn("project", F.element_at(F.split("node_id", "/"), 1))
    return normalise(rows, "value", "project", zones).drop("project")
