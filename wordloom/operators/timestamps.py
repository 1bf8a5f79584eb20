"""Mixed timestamp notations to microseconds since 1970-01-01 UTC.

A cascade of anchored patterns rewrites every notation to one field record; strict checks follow; wall
times get the zone of their source from a lookup; ambiguous and nonexistent wall times follow a stated policy.
Everything stays inside the JVM: one projection, no shuffle, one lookup join.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.storage import broadcast_checked

DAY_US = 86_400_000_000

# Minutes east of UTC of the zone abbreviations that are read.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MON = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?)"
_DAYNAME = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s?\(?((?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})\)?)?(?:\[([A-Za-z_+\-/0-9]+)\])?"
_GAP = r"(?:[Tt]|,?\s+(?:at\s+)?)"
_SEP = "\u0001"

#: Tried in this order; each rewrites a value to kind, year, month, day, order, hour, minute, second, fraction, half, zone, region.
CASCADE: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("epoch_s", r"^(-?\d{9,10})(?:[.,](\d{1,12}))?$", ("es", "$1", "", "", "", "", "", "", "$2", "", "", "")),
    ("epoch_ms", r"^(-?\d{12,13})$", ("em", "$1", "", "", "", "", "", "", "", "", "", "")),
    ("epoch_us", r"^(-?\d{15,16})$", ("eu", "$1", "", "", "", "", "", "", "", "", "", "")),
    ("epoch_ns", r"^(-?\d{18,19})$", ("en", "$1", "", "", "", "", "", "", "", "", "", "")),
    ("iso", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_GAP}{_CLOCK}{_ZONE}$", ("w", "$1", "$3", "$4", "", "$5", "$6", "$7", "$8", "$9", "$10", "$11")),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,12}}))?{_ZONE}$", ("w", "$1", "$2", "$3", "", "$4", "$5", "$6", "$7", "", "$8", "$9")),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_GAP}{_CLOCK}{_ZONE}$", ("w", "$1", "$3", "$4", "src", "$5", "$6", "$7", "$8", "$9", "$10", "$11")),
    ("day_month", rf"^{_DAYNAME}(\d{{1,2}})(?:\.|st|nd|rd|th)?[\s\-]+{_MON}[,\s\-]+(\d{{4}}){_GAP}{_CLOCK}{_ZONE}$", ("w", "$3", "$2", "$1", "", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    ("month_day", rf"^{_DAYNAME}{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_GAP}{_CLOCK}{_ZONE}$", ("w", "$3", "$1", "$2", "", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
    ("ctime", rf"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+{_MON}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,12}}))?(?:\s+([A-Za-z]{{1,5}}|(?:UTC|GMT)?[+\-]\d{{1,2}}(?::?\d{{2}})?))?\s+(\d{{4}})$", ("w", "$8", "$1", "$2", "", "$3", "$4", "$5", "$6", "", "$7", "")),
)


def _fields(value: Column) -> Column:
    c = F.regexp_replace(value, r"^\s+|\s+$", "")
    for _, pattern, groups in CASCADE:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(_SEP.join(groups)))
    return F.when(F.contains(c, F.lit(_SEP)), F.split(c, _SEP))


def _offset(zone: Column) -> Column:
    """Minutes east of UTC that a zone text states, null if it states none that is known."""
    z = F.upper(F.translate(zone, "−", "-"))
    signed = F.regexp_replace(z, r"^(?:UTC|GMT)(?=[+\-])", "")
    h = F.regexp_extract(signed, r"^[+\-](\d{1,2}):?(\d{2})?$", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(signed, r"^[+\-](\d{1,2}):?(\d{2})?$", 2).try_cast("int"), F.lit(0))
    numeric = F.when((h <= 18) & (m < 60), F.when(signed.startswith("-"), -(h * 60 + m)).otherwise(h * 60 + m))
    names = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    return F.when(signed.rlike(r"^[+\-]"), numeric).otherwise(F.try_element_at(names, z))


def _local(instant_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), zone))


def wall_to_utc(wall_us: Column, zone: Column, ambiguous: str = "first", nonexistent: str = "before") -> Column:
    """Instant of a wall time in ``zone``.

    ``ambiguous``: a wall time that occurs twice is read as its ``first`` or ``second`` occurrence, or ``null``.
    ``nonexistent``: a skipped wall time is read with the offset ``before`` or ``after`` the change, or ``null``.
    """
    if ambiguous not in ("first", "second", "null") or nonexistent not in ("before", "after", "null"):
        raise ValueError("unknown policy")
    before = 2 * wall_us - DAY_US - _local(wall_us - DAY_US, zone)
    after = 2 * wall_us + DAY_US - _local(wall_us + DAY_US, zone)
    null = F.lit(None).cast("long")
    twice = {"first": F.least(before, after), "second": F.greatest(before, after), "null": null}[ambiguous]
    skipped = {"before": before, "after": after, "null": null}[nonexistent]
    ok_before, ok_after = _local(before, zone) == wall_us, _local(after, zone) == wall_us
    return (
        F.when(before == after, before)
        .when(ok_before & ok_after, twice)
        .when(ok_before, before)
        .when(ok_after, after)
        .otherwise(skipped)
    )


def normalize_timestamps(
    df: DataFrame,
    feeds: DataFrame,
    *,
    value: str = "createdAt",
    source: str = "source",
    out: str = "utc_us",
    ambiguous: str = "first",
    nonexistent: str = "before",
    default_zone: str = "UTC",
    default_style: str = "ymd",
) -> DataFrame:
    """Add ``out`` (microseconds since 1970 UTC, null if the value names no moment) and ``out_plain``.

    ``feeds`` has source, zone_name and date_style.  A null source, or one that the lookup lacks, counts as
    ``default_zone`` and ``default_style``.  ``out_plain`` is true where the value is already
    ``YYYY-MM-DD HH:MM:SS`` of a feed on UTC.  Null, blank and impossible values, and values without a date or a
    time of day, give null.  Repeated lookup sources: the smallest zone name wins.  Extra columns pass through;
    a column already named ``out`` or ``out_plain`` is replaced.  An empty table gives an empty table.
    """
    lookup = (
        feeds.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__feed"))
        .agg(F.min(F.struct("zone_name", "date_style")).alias("__at"))
        .select("__feed", F.col("__at.zone_name").alias("__zone"), F.col("__at.date_style").alias("__style"))
    )
    keep = [c for c in df.columns if c not in (out, f"{out}_plain")]
    # blank or null sources are given no join key, so that a hot null never meets the lookup
    rows = df.select(*[F.col(f"`{c}`") for c in keep], _fields(F.col(f"`{value}`").cast("string")).alias("__f"))
    rows = rows.join(broadcast_checked(lookup), F.col(f"`{source}`") == F.col("__feed"), "left")
    f = [F.col("__f")[i] for i in range(12)]
    num = lambda c: c.try_cast("long")
    micro = lambda c: F.coalesce(num(F.substring(F.rpad(c, 6, "0"), 1, 6)), F.lit(0))

    def step(*cols: Column) -> None:
        nonlocal rows
        rows = rows.select(*[F.col(f"`{c}`") for c in keep], *cols)

    style = F.coalesce(F.col("__style"), F.lit(default_style))
    by_source = f[4] == "src"
    # numeric days and months stand in the order of the source
    case = F.when(by_source, style).otherwise("ymd")
    step(
        "__f",
        F.coalesce(F.col("__zone"), F.lit(default_zone)).alias("__zone"),
        F.when(case == "ymd", f[1]).otherwise(f[3]).alias("__y"),
        F.when(case == "mdy", f[1]).otherwise(f[2]).alias("__m"),
        F.when(case == "ymd", f[3]).when(case == "mdy", f[2]).otherwise(f[1]).alias("__d"),
    )
    y, m, d = F.col("__y"), F.col("__m"), F.col("__d")
    month_no = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(m, 1, 3)))
    year_no = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(F.length(y) == 4, y)
    hour = num(f[5])
    clock = F.when(f[9] == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(F.lower(f[9]) == "p", 12).otherwise(0))
    step(
        "__f",
        "__zone",
        F.unix_date(F.concat_ws("-", year_no, F.coalesce(num(m), month_no).cast("string"), F.when(F.length(d) <= 2, d)).try_cast("date")).alias("__day"),
        (F.length(y).isin(2, 4) & (F.length(d) <= 2)).alias("__dated"),
        clock.alias("__hour"),
    )
    minute, second = num(f[6]), F.coalesce(num(f[7]), F.lit(0))
    wall = (F.col("__day").cast("long") * 86400 + F.col("__hour") * 3600 + minute * 60 + second) * 1_000_000 + micro(f[8])
    stated = f[10] != ""
    region = F.when(F.array_contains(F.lit(sorted(available_timezones())), f[11]), f[11])
    counted = num(f[1])
    frac = F.when(counted < 0, -micro(f[8])).otherwise(micro(f[8]))
    step(
        F.when(f[0] == "es", counted * 1_000_000 + frac).when(f[0] == "em", counted * 1000).when(f[0] == "eu", counted).when(f[0] == "en", F.floor(counted / 1000)).alias("__epoch"),
        F.when((f[0] == "w") & F.col("__dated") & (minute <= 59) & (second <= 59), wall).alias("__w"),
        F.when(stated, _offset(f[10])).alias("__offset"),
        F.when(stated, F.lit(None).cast("string")).when(f[11] == "", F.col("__zone")).when(f[11] != "", region).alias("__region"),
        (F.col(f"`{value}`").rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z") & (F.col("__zone") == "UTC")).alias("__plain"),
    )
    w, z = F.col("__w"), F.col("__region")
    by_zone = F.when(z == "UTC", w).when(z.isNotNull() & w.isNotNull(), wall_to_utc(w, z, ambiguous, nonexistent))
    utc = F.coalesce(F.col("__epoch"), w - F.col("__offset").cast("long") * 60_000_000, by_zone)
    # the generator keeps later filters on the result from being copied through every step above
    step(F.explode(F.array(F.struct(utc.alias("us"), F.coalesce(F.col("__plain"), F.lit(False)).alias("plain")))).alias("__r"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("__r.us").alias(out), F.col("__r.plain").alias(f"{out}_plain"))
