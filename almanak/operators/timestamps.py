"""Timestamps written in many ways, to one instant in UTC (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanak.functions import zones as Z
from almanak.operators.skew import salted_lookup

# Month names in four languages.
MONTHS = [
    ["january", "jan", "januar", "jän", "jänner", "janvier", "janv", "enero", "ene"],
    ["february", "feb", "februar", "février", "févr", "fév", "febrero"],
    ["march", "mar", "märz", "mär", "mrz", "mars", "marzo"],
    ["april", "apr", "avril", "avr", "abril", "abr"],
    ["may", "mai", "mayo"],
    ["june", "jun", "juni", "juin", "junio"],
    ["july", "jul", "juli", "juillet", "juil", "julio"],
    ["august", "aug", "août", "agosto", "ago"],
    ["september", "sep", "sept", "septembre", "septiembre"],
    ["october", "oct", "oktober", "okt", "octobre", "octubre"],
    ["november", "nov", "novembre", "noviembre"],
    ["december", "dec", "dezember", "dez", "décembre", "déc", "diciembre", "dic"],
]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)"
_DAY = r"(?:[\p{L}]{2,10}\.?,? )?"

#: The cascade: name, anchored pattern, and where the parts are: year|month|day|hour|minute|second|fraction|half of day|zone.
CASCADE: list[tuple[str, str, str]] = [
    ("compact", r"^;?(?:VALUE=DATE(?:-TIME)?;?:?)?(?:;?TZID=\"?([^\":]+)\"?:)?(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(Z)?)?$", "$2|$3|$4|$5|$6|$7|||$1$8"),
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_TIME}(?: ?{_ZONE}(?:\[[^\]]*\])?)?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("iso zone", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME} ?\[([^\]]+)\]$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("iso week", rf"^(\d{{4}})-?W(\d{{2}})-?(\d)(?:T{_TIME} ?{_ZONE}?)?$", "$1|W$2|$3|$4|$5|$6|$7||$8"),
    ("slashed year", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,? {_TIME}(?: ?{_ZONE})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("slashed", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp])\.?[Mm]\.?)?)?$", "$3|S$1|$2|$4|$5|$6||$7|"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME}(?: Uhr)?)?$", "$3|$2|$1|$4|$5|$6|$7||"),
    ("day month", rf"^{_DAY}(\d{{1,2}})\.? (?:de )?([\p{{L}}]{{3,12}})\.?,? (?:de )?(\d{{4}})(?:(?:,| à| um| at| a las)? (\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}}))?(?: Uhr)?(?: {_ZONE})?)?$", "$3|$2|$1|$4|$5|$6|||$7"),
    ("month day", rf"^{_DAY}([\p{{L}}]{{3,12}})\.? (\d{{1,2}}),? (\d{{4}})(?:,?(?: at)? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: ?([AaPp])\.?[Mm]\.?)?(?: {_ZONE})?)?$", "$3|$1|$2|$4|$5|$6||$7|$8"),
    ("year last", rf"^[\p{{L}}]{{2,10}} ([\p{{L}}]{{3,12}}) (\d{{1,2}}) (\d{{2}}):(\d{{2}}):(\d{{2}})(?: {_ZONE})? (\d{{4}})$", "$7|$1|$2|$3|$4|$5|||$6"),
]
EPOCH = r"^\d{10}(?:\d{3}){0,2}$"

FIELDS = {"start_text": "start", "end_text": "end", "recurrence_text": "recurrence_id"}


def tidy(c: Column) -> Column:
    """The text as the cascade reads it: one kind of blank and of minus, none outside."""
    return Z.squeezed(F.translate(c, "−", "-"))


_BY_NAME = {name: (pattern, parts) for name, pattern, parts in CASCADE}


def _tried(text: Column, *names: str) -> Column:
    """The parts by the first of these patterns that takes the text, or the text as it is: parts fit no pattern themselves."""
    for name in names:
        text = F.regexp_replace(text, *_BY_NAME[name])
    return text


def _canonical(text: Column) -> Column:
    """The cascade, entered where the first characters lead: each text meets the patterns that can take it, once, in order."""
    at = lambda i: F.substring(text, i, 1)
    second = lambda *marks: at(2).isin(*marks) | at(3).isin(*marks)
    by_digits = (
        F.when(second("/"), _tried(text, "slashed")).when(second("."), _tried(text, "dotted", "day month")).when(second(" "), _tried(text, "day month"))
        .when((at(5) == "W") | (at(6) == "W"), _tried(text, "iso week")).when(at(5) == "-", _tried(text, "iso", "iso zone")).when(at(5) == "/", _tried(text, "slashed year")).otherwise(_tried(text, "compact"))
    )
    tagged = (at(1) == ";") | text.startswith("TZID") | text.startswith("VALUE")
    return F.when(at(1).between("0", "9"), by_digits).when(tagged, _tried(text, "compact")).otherwise(_tried(text, "day month", "month day", "year last"))


def _month(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n, row in enumerate(MONTHS, 1) for name in row for x in (name, n)])
    return F.element_at(names, word)


def with_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds the parts of a text by the first pattern of the cascade that takes it as a whole: numbers, ``_half`` of the day, ``_ztext``, and ``_epoch`` for seconds and finer since 1970.

    In steps, each of a size that the compiler takes: one expression over all
    parts would run interpreted.
    """
    kept = df.columns
    df = df.withColumn("_t", tidy(F.col(text))).withColumn("_c", _canonical(F.col("_t")))
    df = df.withColumn("_p", F.split(F.when(F.col("_c") != F.col("_t"), F.col("_c")), r"\|"))
    # what begins with a digit is a number here; a cast that fails costs far more than a look at the first character
    df = df.withColumn("_n", F.transform("_p", lambda x: F.when(x.between("0", ":"), x.try_cast("int"))))
    number = lambda i: F.get("_n", F.lit(i))
    word = F.lower(F.get("_p", F.lit(1)))
    mark = F.substring(word, 1, 1)
    marked = F.when(F.substring(word, 2, 1).between("0", "9"), F.substring(word, 2, 2).try_cast("int"))
    fraction = F.nullif(F.get("_p", F.lit(6)), F.lit(""))
    return df.select(
        *kept, number(0).alias("_y"), number(2).alias("_d"), F.when(mark == "s", marked).alias("_first"), F.when((mark == "w") & marked.isNotNull(), marked).alias("_week"), F.coalesce(number(1), _month(word)).alias("_m"),
        F.coalesce(number(3), F.lit(0)).alias("_hour"), F.coalesce(number(4), F.lit(0)).alias("_minute"), F.coalesce(number(5), F.lit(0)).alias("_second"), F.upper(F.nullif(F.get("_p", F.lit(7)), F.lit(""))).alias("_half"),
        F.when(fraction.isNull(), F.lit(0)).otherwise(F.rpad(fraction, 6, "0").try_cast("int")).alias("_fraction"), F.nullif(F.get("_p", F.lit(8)), F.lit("")).alias("_ztext"),
        F.when(F.col("_t").rlike(EPOCH), F.rpad("_t", 16, "0").try_cast("bigint")).alias("_epoch"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the proleptic Gregorian calendar, in whole numbers: years begin in March, so the odd day is the last."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(year / 400).cast("int")
    of_era = year - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5).cast("int") + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4).cast("int") - F.floor(of_era / 100).cast("int") + of_year - 719468


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date that exists, else null."""
    last = F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(m.between(1, 12) & (d >= 1) & (d <= last) & y.between(1, 9999), _days(y, m, d))


def _date_of_week(y: Column, week: Column, weekday: Column) -> Column:
    """Days since 1970-01-01 of a day of an ISO week that the year has, else null."""
    fourth = _days(y, F.lit(1), F.lit(4))  # always in week 1; 1970-01-01 was a Thursday
    monday = fourth - (fourth + 3) % 7
    next_monday = _days(y + 1, F.lit(1), F.lit(4))
    next_monday = next_monday - (next_monday + 3) % 7
    at = monday + (week - 1) * 7 + weekday - 1
    return F.when((week >= 1) & weekday.between(1, 7) & (at < next_monday), at)


def parse_times(df: DataFrame, text: str, day_first: str, zone: str, offset: str) -> DataFrame:
    """Adds ``utc_us`` to a frame with a text, whether slashed dates put the day first, and the default zone or offset.

    Strict: a text that no anchored pattern takes as a whole, a date that does
    not exist, an hour above 23 (but 24:00 ends a day), and an unknown zone
    give null. An offset in the text wins over a zone in brackets after it.
    """
    if "_y" not in df.columns:
        df = with_parts(df, text)
    own = ("_y", "_d", "_first", "_week", "_m", "_hour", "_minute", "_second", "_half", "_fraction", "_ztext", "_epoch")
    kept = [c for c in df.columns if c not in own]
    c = F.col
    swapped = c("_first").isNotNull() & F.coalesce(F.col(day_first), F.lit(True))
    hour = F.when(c("_half").isNull(), c("_hour")).when(c("_hour").between(1, 12), c("_hour") % 12 + F.when(c("_half") == "P", 12).otherwise(0))
    df = df.select(
        *kept, "_y", F.when(swapped, c("_d")).when(c("_first").isNotNull(), c("_first")).otherwise(c("_m")).alias("_m"), F.when(swapped, c("_first")).otherwise(c("_d")).alias("_d"),
        "_week", hour.alias("_hour"), "_minute", "_second", "_fraction", "_half", "_ztext", "_epoch")
    in_day = (c("_hour").between(0, 23) & c("_minute").between(0, 59) & c("_second").between(0, 59)) | ((c("_hour") == 24) & (c("_minute") == 0) & (c("_second") == 0) & (c("_fraction") == 0) & c("_half").isNull())
    df = df.select(
        *kept, F.when(c("_y") >= 1, F.when(c("_week").isNotNull(), _date_of_week(c("_y"), c("_week"), c("_d"))).otherwise(_date(c("_y"), c("_m"), c("_d")))).alias("_date"),
        F.when(in_day, (c("_hour") * 3600 + c("_minute") * 60 + c("_second")).cast("bigint") * 1000000 + c("_fraction")).alias("_us"), "_ztext", "_epoch")
    df = df.withColumn("_zoffset", F.when(F.col("_ztext").isNotNull(), F.when(F.upper("_ztext").isin("Z", "UTC"), 0).otherwise(Z.offset_minutes(F.col("_ztext")))))
    df = Z.with_zone(df, F.when(F.col("_zoffset").isNull(), F.col("_ztext")), "_zname")
    use_offset = F.when(F.col("_ztext").isNull(), F.col(offset)).otherwise(F.col("_zoffset"))
    use_zone = F.when(F.col("_ztext").isNull(), F.col(zone)).otherwise(F.col("_zname"))
    local_us = F.col("_date").cast("bigint") * 86400000000 + F.col("_us")
    instant = F.when(use_offset.isNotNull(), local_us - use_offset.cast("bigint") * 60000000).otherwise(Z.local_to_utc_us(local_us, use_zone))
    utc = F.coalesce("_epoch", instant)
    return df.withColumn("utc_us", utc).drop("_date", "_us", "_ztext", "_zoffset", "_zname", "_epoch")


def day_first_of(values: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``day_first``: the order of day and month that a source keeps in slashed dates.

    One number above 12 decides; the more frequent kind wins where a source
    has both, and the day comes first where it has neither.
    """
    shape = r"^(\d{1,2})/(\d{1,2})/\d{4}(?:\D|$)"
    t = tidy(F.col(text))
    rows = values.filter(F.col(text).contains("/")).select(key, F.when(t.rlike(shape), t).alias("_t"))
    a, b = F.substring_index("_t", "/", 1).try_cast("int"), F.substring_index(F.substring_index("_t", "/", 2), "/", -1).try_cast("int")
    rows = rows.select(key, a.alias("_a"), b.alias("_b"))
    vote = F.when(F.col("_a").between(13, 31) & (F.col("_b") <= 12), 1).when(F.col("_b").between(13, 31) & (F.col("_a") <= 12), -1).otherwise(0)
    return rows.groupBy(key).agg(F.sum(vote).alias("_votes")).select(key, (F.col("_votes") >= 0).alias("day_first"))


def normalise_times(raw: DataFrame, calendars: DataFrame) -> DataFrame:
    """``raw_no``, ``field``, ``utc_us`` of every readable value.

    The default zone is the calendar's; UTC where the calendar is missing or
    its ``time_zone`` is null or unreadable. Null, blank and unreadable texts
    give no row; a row received twice gives rows for each ``raw_no``. Empty
    tables give an empty result. Repeated rows of one ``raw_no`` collapse only
    if they say the same.
    """
    pairs = [F.struct(F.lit(name).alias("field"), F.col(c).alias("text")) for c, name in FIELDS.items()]
    values = raw.select("raw_no", "feed_no", F.explode(F.array(*pairs)).alias("v")).select("raw_no", "feed_no", "v.field", "v.text")
    values = values.filter(F.col("text").rlike(r"\d"))
    zones = Z.with_zone(calendars.select("feed_no", "time_zone"), F.col("time_zone"), "zone")
    zones = zones.groupBy("feed_no").agg(F.min(F.struct("time_zone", "zone")).alias("z")).select("feed_no", F.coalesce("z.zone", F.lit("UTC")).alias("zone"), F.when(F.col("z.zone").isNull(), Z.offset_minutes(F.col("z.time_zone"))).alias("offset"))
    feeds = zones.join(day_first_of(values, "feed_no", "text"), "feed_no", "full_outer")
    parts = with_parts(values, "text").drop("text")  # the patterns run beside the scan
    values = salted_lookup(parts, feeds, ["feed_no"], "raw_no").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
    out = parse_times(values, "text", "day_first", "zone", "offset")
    # not a filter: the optimiser would move that down, and everything under it would be worked out twice
    return out.select("raw_no", "field", F.explode(F.array_compact(F.array("utc_us"))).alias("utc_us"))
