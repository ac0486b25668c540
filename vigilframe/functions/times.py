"""Timestamps in the formats logs use, as microseconds since the epoch (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.folds import once

# The plausible range of telemetry, 1990-01-01 to 2200-01-01.
MIN_US, MAX_US = 631_152_000_000_000, 7_258_118_400_000_000
DAY_US = 86_400_000_000
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _month(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, f"{i:02d}")))
    return F.try_element_at(numbers, F.lower(name))


def epoch_micros(number: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, told apart by size."""
    size = F.abs(number)
    scaled = (
        F.when(size >= 1e17, number / 1e3).when(size >= 1e14, number).when(size >= 1e11, number * 1e3)
        .otherwise(number * 1e6)
    )
    return F.round(scaled).cast("long")


def parse_micros(text: Column, reference_us: Column | None = None) -> Column:
    """Microseconds for ISO variants, epoch numbers, web-server, syslog (year from ``reference_us``), US and mail dates.

    The form is told first; only the groups of that form are then taken out. Text and result stand in the plan once.
    """
    def checked(t: Column) -> Column:
        return once(_by_form(t, reference_us), lambda us: F.when((F.length(t) <= 64) & us.between(MIN_US, MAX_US - 1), us))

    return once(F.trim(text), checked)


def _by_form(t: Column, reference_us: Column | None) -> Column:
    number = t.try_cast("double")

    iso = F.regexp_replace(t, r"(:\d{2}),(\d)", "$1.$2")
    iso = F.regexp_replace(iso, r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"(?: UTC|[Zz])$", "+00:00")
    iso = F.regexp_replace(iso, r"\s+(?=[+-]\d{2}:?\d{2}$)", "")
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.regexp_replace(iso, r"(\.\d{6})\d+", "$1")
    # a text without offset is UTC
    iso = once(iso, lambda x: F.when(x.rlike(r"[+-]\d{2}:\d{2}$"), x).otherwise(F.concat(x, F.lit("+00:00"))))
    iso_us = _micros(iso.try_cast("timestamp"))

    def assemble(year: Column, month: Column, day: Column, clock: Column, offset: Column) -> Column:
        return _micros(
            F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), clock, offset).try_cast("timestamp")
        )

    web = r"^\[?(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}:\d{2}:\d{2})\s*([+-]\d{4})?\]?$"

    def w(i: int) -> Column:
        return F.regexp_extract(t, web, i)

    web_offset = once(w(5), lambda z: F.when(z == "", "+00:00").otherwise(F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))))
    web_us = assemble(w(3), _month(w(2)), w(1), w(4), web_offset)

    sys_re = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$"

    def s(i: int) -> Column:
        return F.regexp_extract(t, sys_re, i)

    ref = reference_us if reference_us is not None else F.unix_micros(F.current_timestamp())
    year = F.year(F.timestamp_micros(ref))

    def syslog_for(y: Column) -> Column:
        return assemble(y.cast("string"), _month(s(1)), s(2), s(3), F.lit("+00:00"))

    # a date more than a day ahead of the reference belongs to the year before
    sys_us = once(syslog_for(year), lambda us: F.when(us - DAY_US > ref, syslog_for(year - 1)).otherwise(us))

    us_re = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})\s*([AaPp][Mm])?$"

    def u(i: int) -> Column:
        return F.regexp_extract(t, us_re, i)

    hour = u(4).try_cast("int")
    hour = F.when(u(7) == "", hour).otherwise(hour % 12 + F.when(F.lower(u(7)) == "pm", 12).otherwise(0))
    clock = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), u(5), F.lit(":"), u(6))
    us_us = assemble(u(3), F.lpad(u(1), 2, "0"), u(2), clock, F.lit("+00:00"))

    mail_re = r"^(?:[A-Za-z]{3}, ?)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2})\s*(?:([+-]\d{2})(\d{2})|GMT|UTC)?$"

    def m(i: int) -> Column:
        return F.regexp_extract(t, mail_re, i)

    mail_offset = F.when(m(5) == "", "+00:00").otherwise(F.concat(m(5), F.lit(":"), m(6)))
    mail_us = assemble(m(3), _month(m(2)), m(1), m(4), mail_offset)

    return (
        F.when(t.rlike(r"^-?\d+(\.\d+)?$"), epoch_micros(number))
        .when(t.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}"), iso_us)
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _micros(F.concat(t, F.lit("T00:00:00+00:00")).try_cast("timestamp")))
        .when(t.rlike(web), web_us)
        .when(t.rlike(sys_re), sys_us)
        .when(t.rlike(us_re), us_us)
        .when(t.rlike(mail_re), mail_us)
    )


def duration_micros(text: Column) -> Column:
    """``15m``, ``-2h``, ``+1d`` as microseconds."""
    pattern = r"^([+-]?)(\d+(?:\.\d+)?)(ms|s|m|h|d|w)$"
    unit = F.regexp_extract(text, pattern, 3)
    size = (
        F.when(unit == "ms", 1_000).when(unit == "s", 1_000_000).when(unit == "m", 60_000_000).when(unit == "h", 3_600_000_000)
        .when(unit == "d", DAY_US).when(unit == "w", 7 * DAY_US)
    )
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    return F.when(text.rlike(pattern), F.round(sign * F.regexp_extract(text, pattern, 2).try_cast("double") * size).cast("long"))
