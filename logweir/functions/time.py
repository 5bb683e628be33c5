"""Timestamps: shapes to instants, instants to text. The session's time zone has to be UTC."""

from __future__ import annotations

from datetime import timezone

import pandas as pd
from dateutil import parser as free_parser
from pyspark.sql import Column, SparkSession, functions as F, types as T

from .text import let, strip

# The shapes of timestamps that logs use.
_CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
_FRACTION = r"(?:\.(\d{1,6}))?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
TOKEN = (
    r"(?i)(?:\d{4}[-/]\d{2}[-/]\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?"
    r"|\d{2}[-/]\d{2}[-/]\d{4}(?:\s\d{2}:\d{2}:\d{2})?"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}(?:\s+\d{4})?\s+\d{2}:\d{2}:\d{2}(?:\s+[+-]\d{4})?)"
)
ISO_T = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T{_CLOCK}{_FRACTION}(?:(Z)|([+-]\d{{2}}):?(\d{{2}}))?$"
DASHED = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})\s+{_CLOCK}{_FRACTION}$"
SLASHED = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})\s+{_CLOCK}$"
CLF = rf"^(\d{{1,2}})/{_MONTH}/(\d{{4}}):{_CLOCK}\s+([+-]\d{{2}}):?(\d{{2}})$"
MONTH_DAY = rf"^{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}$"
MONTH_DAY_YEAR = rf"^{_MONTH}\s+(\d{{1,2}})\s+(\d{{4}})\s+{_CLOCK}$"
DAY_DASHED = rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}})\s+{_CLOCK}$"
DAY_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}$"
DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
DATE_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _month(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(name)) + 2) / 3).cast("int").cast("string")


def _canonical(s: Column, reference_year: Column) -> tuple[Column, Column]:
    """The text as year-month-day clock zone, and the same with day and month exchanged where both orders are tried."""
    named = F.regexp_extract(F.lower(s), _MONTH, 1)
    as_is = lambda shape, to: F.regexp_replace(s, shape, to)
    with_month = lambda shape, to: F.replace(F.regexp_replace(s, "(?i)" + shape, to), F.lit("MON"), _month(named))
    first = (
        F.when(s.rlike(ISO_T), F.rtrim(F.regexp_replace(as_is(ISO_T, "$1-$2-$3 $4:$5:$6.$7$8$9:$10"), r"\.?:$|\.(?=[Z+-])|:$", "")))
        .when(s.rlike(DASHED), F.regexp_replace(as_is(DASHED, "$1-$2-$3 $4:$5:$6.$7"), r"\.$", ""))
        .when(s.rlike(SLASHED), as_is(SLASHED, "$1-$2-$3 $4:$5:$6"))
        .when(s.rlike("(?i)" + CLF), with_month(CLF, "$3-MON-$1 $4:$5:$6$7:$8"))
        .when(s.rlike("(?i)" + MONTH_DAY), F.concat(reference_year, F.lit("-"), with_month(MONTH_DAY, "MON-$2 $3:$4:$5")))
        .when(s.rlike("(?i)" + MONTH_DAY_YEAR), with_month(MONTH_DAY_YEAR, "$3-MON-$2 $4:$5:$6"))
        .when(s.rlike(DAY_DASHED), as_is(DAY_DASHED, "$3-$2-$1 $4:$5:$6"))
        .when(s.rlike(DAY_SLASHED), as_is(DAY_SLASHED, "$3-$1-$2 $4:$5:$6"))
        .when(s.rlike(DATE), s)
        .when(s.rlike(DATE_SLASHED), as_is(DATE_SLASHED, "$3-$2-$1"))
    )
    second = F.when(s.rlike(DAY_DASHED), as_is(DAY_DASHED, "$3-$1-$2 $4:$5:$6")).when(s.rlike(DATE_SLASHED), as_is(DATE_SLASHED, "$3-$1-$2"))
    return first, second


def parse_timestamp(text: Column, reference_year: int | None = None) -> Column:
    """The instant that a whole text names, or null. A text without a year, or with 1900, gets reference_year (this year if None); Feb 29 without a year is no date."""
    year = F.year(F.current_date()) if reference_year is None else F.lit(reference_year)

    def instant(s: Column) -> Column:
        first, second = _canonical(s, year.cast("string"))
        return F.coalesce(F.when(~s.rlike(r"(?i)^feb\s+29\s+\d{1,2}:"), first).try_cast("timestamp"), second.try_cast("timestamp"))

    shaped = lambda s: F.when(s.rlike(r"^(?:\d|[A-Za-z]{3}\s)"), let(instant(s), lambda t: F.when(F.year(t) == 1900, t + F.make_interval(years=year - 1900)).otherwise(t)))
    return let(strip(text), shaped)


def extract_timestamp(text: Column) -> Column:
    """The first timestamp-shaped token of a text, or null."""
    return F.nullif(F.regexp_extract(text, TOKEN, 0), F.lit(""))


def to_iso8601(instant: Column) -> Column:
    return F.date_format(instant, _ISO_OUT)


# Shapes of the canonical records' timestamps that the log shapes above lack.
DAY_MON_YEAR = rf"^(\d{{1,2}})-{_MONTH}-(\d{{4}})\s+{_CLOCK}$"
ANY_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def need_utc(spark: SparkSession) -> None:
    """ValueError unless the session's time zone is UTC: texts without a zone would be read in another one."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    rules = spark.sparkContext._jvm.java.time.ZoneId.of(zone).getRules()
    if not rules.isFixedOffset() or rules.getOffset(spark.sparkContext._jvm.java.time.Instant.EPOCH).getTotalSeconds():
        raise ValueError(f"spark.sql.session.timeZone has to be UTC, not {zone}")


def isoformat(instant: Column) -> Column:
    """With +00:00, and with microseconds only where there are any."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(instant, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


@F.pandas_udf(T.StringType())
def free_form(text: pd.Series) -> pd.Series:
    """ISO text of a time in any usual wording, UTC where it names no zone, or null. For what the shapes don't know: rows that are null cost nothing."""

    def told(x: str) -> str | None:
        try:
            at = free_parser.parse(x.strip())
        except (ValueError, OverflowError):
            return None
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).isoformat()

    return text.map(told, na_action="ignore")


def standardise_timestamp(text: Column) -> tuple[Column, Column]:
    """ISO text and whether it was readable: ISO stays, epochs of ten digits or more, then the known shapes; what fails stays as it is."""
    def known(s: Column) -> Column:
        epoch = F.when(s.rlike(r"^\d{10,}$"), s.try_cast("double"))
        seconds = F.when(epoch > 1e12, epoch / 1000).otherwise(epoch)
        named = _month(F.regexp_extract(F.lower(s), _MONTH, 1))
        to = lambda shape, form: F.when(s.rlike("(?i)" + shape), F.replace(F.regexp_replace(s, "(?i)" + shape, form), F.lit("MON"), named)).try_cast("timestamp")
        found = (F.when(seconds < 253402300800, F.timestamp_micros((seconds * 1000000).cast("long"))), to(DAY_MON_YEAR, "$3-MON-$1 $4:$5:$6"), to(MONTH_DAY, "1900-MON-$2 $3:$4:$5"), F.when(~s.rlike("(?i)" + MONTH_DAY), parse_timestamp(s)), to(DAY_SLASHED, "$3-$2-$1 $4:$5:$6"))
        return F.coalesce(*found)

    iso = text.rlike(ANY_ISO)
    told = let(F.when(~iso, let(strip(text), known)), lambda t: F.struct(F.when(iso, text).otherwise(F.coalesce(isoformat(t), text)).alias("text"), (text.isNull() | iso | t.isNotNull()).alias("ok")))
    return told["text"], told["ok"]
