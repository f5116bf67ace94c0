"""Reading dates: what layouts a column's texts have, which one is its own, and the reader for it.

Texts that start with a year and a dash are cast as they are. All other layouts are told apart by one regular expression that
lays a text out as fields; the fields are bound once (as the argument of a lambda), so the plan holds the expression once
however often a reader looks at them. Nothing here raises on bad input; what cannot be read becomes NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

_MONTH = (r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|"
          r"Nov(?:ember)?|Dec(?:ember)?")
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_TH = "(?:st|nd|rd|th)?"

# The parts of a text, as named groups. Alternatives have groups of their own, of which one alternative fills some.
_SHAPE = (
    r"(?i)^(?<weekday>(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,?\s+)?(?:"
    r"(?<y1>\d{4})(?<s1>[-/.])(?<m1>\d{1,2})\k<s1>(?<d1>\d{1,2})"
    r"|(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})"
    r"|(?<a>\d{1,2})(?<s3>[-/.])(?<b>\d{1,2})\k<s3>(?<y3>\d{4}|\d{2})"
    rf"|(?<n4>{_MONTH})\.?[ -](?<d4>\d{{1,2}}){_TH},?[ -](?<y4>\d{{4}})"
    rf"|(?<d5>\d{{1,2}}){_TH}(?<s5>[ -])(?<n5>{_MONTH})\.?,?[ -](?<y5>\d{{4}}|\d{{2}})"
    rf"|(?<n6>{_MONTH})\.?,?[ -](?<y6>\d{{4}})"
    rf"|(?<n7>{_MONTH}) +(?<d7>\d{{1,2}}) (?<h7>\d{{1,2}})(?<c7>:\d{{2}}:\d{{2}}) (?<y7>\d{{4}})"
    r")(?:[ T]\s*(?<h>\d{1,2})(?<c>:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(?:\s*(?<half>[AP])M)?"
    r"(?:\s*(?:(?<zone>UTC|GMT|Z)|(?<zh>[+-]\d{2}):?(?<zm>\d{2})))?)?$")
_PLAIN_ISO = r"^\d{4}-\d{1,2}-\d{1,2}\z"
_FIELDS = {
    "mark": "\u0001", "year": "${y1}${y2}${y3}${y4}${y5}${y6}${y7}", "month": "${m1}${m2}", "day": "${d1}${d2}${d4}${d5}${d7}",
    "name": "${n4}${n5}${n6}${n7}", "first": "${a}", "second": "${b}", "hour": "${h}${h7}", "clock": "${c}${c7}", "half": "${half}",
    "zone": "${zone}", "zone_hour": "${zh}", "zone_minute": "${zm}", "weekday": "${weekday}", "between": "${s1}${s3}${s5}"}
_PLACE = {name: i for i, name in enumerate(_FIELDS)}

#: Layouts by name. Those of numbers alone are patterns that Spark reads as they stand.
YEAR_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd")
NUMERIC = tuple(f"{one}{s}{two}{s}{year}" for one, two in ("Md", "dM") for s in "/-." for year in ("yyyy", "yy"))
NAMED = ("MMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy", "d MMM yy", "d-MMM-yy", "MMM yyyy")
LAYOUTS = (*YEAR_FIRST, *NUMERIC, *NAMED)


@dataclass(frozen=True)
class DateReading:
    """How a column is read: ``day_first`` says how two numbers before a year are meant, ``layout`` names the only layout
    to accept (any, if None), ``plain`` that its texts are a date in that layout and nothing more."""

    layout: str | None = None
    day_first: bool = False
    plain: bool = False

    @staticmethod
    def only(layout: str) -> DateReading:
        """Accept one layout; "iso" stands for a year with a dash behind it."""
        return DateReading(layout, layout.startswith("d"))


ANY = DateReading()


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _fields(text: Column) -> Column:
    """A text laid out as fields; an array of one element where no layout fits."""
    return F.split(F.regexp_replace(text, _SHAPE, "|".join(_FIELDS.values())), r"\|")


def _part(fields: Column, name: str) -> Column:
    return F.get(fields, F.lit(_PLACE[name]))


def _whole(part: Column) -> Column:
    """A part of digits as a whole number; NULL where it is empty. A cast of empty text would raise and catch an error for each row."""
    return F.when(part != "", part.cast("int"))


def _layout(fields: Column, day_first: bool) -> Column:
    """The layout's name; NULL where none fits."""
    part = lambda name: _part(fields, name)
    between, year = part("between"), F.repeat(F.lit("y"), F.length(part("year")))
    one, two = ("d", "M") if day_first else ("M", "d")
    joined = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(F.size(fields) == len(_FIELDS), F.when(part("first") != "", joined(one, between, two, between, year))
                  .when(part("month") != "", F.when(between == "", "yyyyMMdd").otherwise(joined("yyyy", between, "M", between, "d")))
                  .when(between != "", joined("d", between, "MMM", between, year))
                  .when(part("day") == "", "MMM yyyy").otherwise("MMM d, yyyy"))


def _instant(fields: Column, reading: DateReading) -> Column:
    """The timestamp that the fields tell."""
    part = lambda name: _part(fields, name)
    year, name = part("year"), part("name")
    # Two-digit years up to 68 are of this century.
    whole_year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)
    one, two = ("second", "first") if reading.day_first else ("first", "second")
    number = ((F.position(F.lower(F.substring(name, 1, 3)), F.lit(_MONTHS)) + 2) / 3).cast("int").cast("string")
    month = F.when(part("first") != "", part(one)).when(name != "", number).otherwise(part("month"))
    day = F.when(part("first") != "", part(two)).when((part("day") == "") & (name != ""), "1").otherwise(part("day"))
    hour, half = _whole(part("hour")), F.lower(part("half"))
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    zone = F.when(part("zone_hour") != "", F.concat(part("zone_hour"), F.lit(":"), part("zone_minute"))).otherwise(F.upper(part("zone")))
    clock = F.when(part("clock") == "", "").otherwise(F.concat(
        F.lit(" "), hour.cast("string"), part("clock"), F.when(zone == "", "").when(F.length(part("clock")) == 3, F.concat(F.lit(":00"), zone)).otherwise(zone)))
    written = F.concat(whole_year, F.lit("-"), month, F.lit("-"), day, clock)
    read = F.when(F.size(fields) == len(_FIELDS), written.try_cast("timestamp"))
    return F.when(_layout(fields, reading.day_first) == reading.layout, read) if reading.layout else read


def to_ts(c: Column, dtype: T.DataType = T.StringType(), reading: DateReading | str | None = None) -> Column:
    """Read a column as TIMESTAMP; what no layout fits becomes NULL.

    ``reading`` is what ``elect_dates`` found for the column, or the name of the one layout to accept. Without it every row is
    read by itself, the month before the day.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if not isinstance(dtype, (T.IntegralType, T.StringType)):
        return F.lit(None).cast("timestamp")
    reading = DateReading.only(reading) if isinstance(reading, str) else reading or ANY
    text = F.trim(c.cast("string"))
    # The cast alone would read "10:00" as today and "2026" as its first day.
    iso = F.when(F.substring(text, 5, 1) == "-", text.try_cast("timestamp"))
    if reading.layout in ("iso", "yyyy-M-d"):
        return iso
    if reading.plain:
        return F.try_to_timestamp(text, F.lit(reading.layout))
    told = _bound(_fields(text), lambda fields: _instant(fields, reading))
    return told if reading.layout else F.coalesce(iso, told)


def _column_facts(c: Column, name: str) -> tuple[Column, dict[tuple[str, str], Column]]:
    """A column that lays a text out, and aggregates over it that count layouts."""
    names = ("layout", "whole_day", "bare", "first", "second")
    kind_of = lambda *parts: F.struct(*[part.alias(n) for n, part in zip(names, parts)])
    text, none = F.trim(c), F.lit(None).cast("int")
    told = _bound(_fields(text), lambda f: kind_of(
        _layout(f, False), _part(f, "clock") == "", _part(f, "weekday") == "", _whole(_part(f, "first")), _whole(_part(f, "second"))))
    # Plain dates of the commonest layout need no fields.
    kind = F.when(text.rlike(_PLAIN_ISO), kind_of(F.lit(YEAR_FIRST[0]), F.lit(True), F.lit(True), none, none)).otherwise(told)
    k = F.col(f"`{name}`")
    facts = {(layout, "n"): F.count_if(k["layout"] == layout) for layout in (*YEAR_FIRST, *NUMERIC[:len(NUMERIC) // 2], *NAMED)}
    facts["all", "plain"] = F.count_if(k["layout"].isNotNull() & k["whole_day"] & k["bare"])
    facts["all", "day_first"] = F.count_if((k["first"] > 12) & (k["second"] <= 12))
    facts["all", "month_first"] = F.count_if((k["second"] > 12) & (k["first"] <= 12))
    return kind, facts


def layout_facts(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """The table with text columns laid out, and aggregates that tell each column's reading (see ``readings``), so that they
    can ride on another pass over the table."""
    facts, kinds = {}, {}
    for name in columns:
        if isinstance(df.schema[name].dataType, T.StringType):
            kinds[f"layout of {name}"], found = _column_facts(F.col(f"`{name}`"), f"layout of {name}")
            facts |= {(name, f"{layout}/{fact}"): aggregate for (layout, fact), aggregate in found.items()}
    return df.withColumns(kinds) if kinds else df, facts


def readings(facts: Mapping[tuple[str, str], int]) -> dict[str, DateReading]:
    """The reading of each column, from the counts of its layouts.

    The day comes first where more texts can only be read so than can only be read with the month first. If every readable
    text has one layout, that is the column's only one.
    """
    found = {}
    for name in dict.fromkeys(column for column, _ in facts):
        own = {fact: n or 0 for (column, fact), n in facts.items() if column == name}
        day_first = own.pop("all/day_first") > own.pop("all/month_first")
        plain, used = own.pop("all/plain"), {fact.removesuffix("/n"): n for fact, n in own.items() if n}
        layout = next(iter(used)) if len(used) == 1 else None
        if layout in NUMERIC and day_first:
            layout = NUMERIC[NUMERIC.index(layout) + len(NUMERIC) // 2]
        readable = layout in (*YEAR_FIRST, *NUMERIC) and not layout.endswith("/yy") and layout[-3:] not in ("-yy", ".yy")
        found[name] = DateReading(layout, day_first, bool(layout) and readable and plain == sum(used.values()))
    return found


def elect_dates(df: DataFrame, columns: Sequence[str]) -> dict[str, DateReading]:
    """The reading of each text column, in one pass over the table."""
    laid_out, facts = layout_facts(df, columns)
    if not facts:
        return {}
    row = laid_out.agg(*[a.alias(f"f{i}") for i, a in enumerate(facts.values())]).first()
    return readings({name: row[f"f{i}"] for i, name in enumerate(facts)})
