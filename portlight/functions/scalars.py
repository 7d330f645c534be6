"""Scalar functions: Column in, Column out. '' and null differ where that matters to the rules, and are told apart here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status texts that mean a shipment is under way.
IN_TRANSIT = r"(?i)in\s*transit|picked\s*up|load\s*picked|departed|en\s*route|pickedup|intransit"
#: Status codes of electronic documents by group; all others are errors.
POSTED, PENDING, RETRYING = ("53", "57"), ("50", "52", "55", "56", "62", "63"), ("59", "60", "61")
TRUE_WORDS = ("true", "1", "yes", "x")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_null(c) -> Column:
    """'' becomes null."""
    return F.nullif(col(c), F.lit(""))


def first_text(*cs) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[blank_null(c) for c in cs])


def line_item(c) -> Column:
    """Trimmed; all digits: without leading zeros, then filled to 5; '' is null. Longer numbers keep their digits."""
    t = F.trim(col(c).cast("string"))
    z = F.regexp_replace(t, r"^0+(?=\d)", "")
    return F.when(t == "", None).when(t.rlike(r"^\d+$"), F.when(F.length(z) < 5, F.lpad(z, 5, "0")).otherwise(z)).otherwise(t)


def priority(c) -> Column:
    """Trimmed and in capitals, valid or not."""
    return F.upper(F.trim(col(c)))


def is_priority(c) -> Column:
    return F.coalesce(priority(c).isin("HIGH", "MEDIUM", "LOW"), F.lit(False))


def composite_key(*cs) -> Column:
    """The trimmed columns joined by |; null counts as empty."""
    return F.concat_ws("|", *[F.coalesce(F.trim(col(c).cast("string")), F.lit("")) for c in cs])


def distinct_list(c) -> Column:
    """Trimmed texts of an array, the first of each, without empty ones."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x.cast("string"))), lambda x: x != ""))


def json_list(c) -> Column:
    """A JSON array as texts; anything else has none."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def config_value(c) -> Column:
    """struct(value, error) of a configuration text: a JSON array, its texts trimmed and distinct, or a JSON object, as JSON."""
    text = F.trim(col(c))
    items, fields = F.from_json(text, "array<string>"), F.try_parse_json(text)
    array, thing = F.startswith(text, F.lit("[")) & items.isNotNull(), F.startswith(text, F.lit("{")) & fields.isNotNull()
    value = F.when(array, F.to_json(distinct_list(items))).when(thing, F.to_json(fields))
    error = F.when(col(c).isNotNull() & value.isNull(), F.when(fields.isNull(), "value must be valid JSON").otherwise("value must be a JSON array or object"))
    return F.struct(value.alias("value"), error.alias("error"))


def positive_number(c, default: int) -> Column:
    """A whole number above 0: from a JSON number, else from the first such number of a JSON object, else from leading digits."""
    text = col(c)
    values = F.map_values(F.from_json(text, "map<string,string>"))
    number = F.coalesce(text.try_cast("double"), F.get(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v > 0), F.lit(0)), blank_null(F.regexp_extract(text, r"^\s*(\d+)", 1)).try_cast("double"))
    return F.coalesce(F.when(number >= 1, F.floor(number).cast("long")), F.lit(default).cast("long"))


def movement_label(c) -> Column:
    """What the status letters of a delivery mean."""
    code = F.upper(F.trim(col(c)))
    return F.when(code == "A", "A (Active / ASN received)").when(code == "B", "B (In process / in transit)").when(code == "C", "C (Completed)").otherwise(first_text(c, F.lit("No ASN")))


def token_total(total, sent, received) -> Column:
    """The total as given, else the sum of both sides."""
    return F.coalesce(col(total), F.coalesce(col(sent), F.lit(0)) + F.coalesce(col(received), F.lit(0)))


def masked_secret(c) -> Column:
    return F.when(first_text(c).isNotNull(), F.lit("*" * 16))


def iso_text(c) -> Column:
    """A timestamp text with T and Z; one with a T stays."""
    t = blank_null(c)
    return F.when(F.contains(t, F.lit("T")), t).otherwise(F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z")))


def decimal_or_null(c, digits: int = 3) -> Column:
    text = col(c).cast("string")
    return F.when(text.rlike(r"\d"), text.try_cast(f"decimal(23,{digits})"))  # a failed cast makes an exception, which takes longer than the pattern


def split_list(c) -> Column:
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def clamp(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsis(c, n: int = 250) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def without_fences(c) -> Column:
    """Text inside a Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"(?i)^```[a-z]*\s*", ""), r"\s*```$", ""))


def document_group(c) -> Column:
    code = F.trim(col(c).cast("string"))
    code = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    return F.when(code.isin(*POSTED), "POSTED").when(code.isin(*PENDING), "PENDING").when(code.isin(*RETRYING), "RETRYING").otherwise("ERROR")


def run_status(c) -> Column:
    s = F.upper(F.coalesce(col(c), F.lit("")))
    return (
        F.when(s.isin("SUCCESS", "SUCCEEDED", "COMPLETED"), "SUCCESS").when(s.isin("FAILURE", "FAILED", "FAIL"), "FAILURE").when(s == "ERROR", "ERROR")
        .when(s.isin("RUNNING", "IN_PROGRESS", "EXECUTING"), "RUNNING").when(s == "", "UNKNOWN").otherwise(s)
    )


def duration_text(started, completed) -> Column:
    """'3m 5s' or '42s'; null when unfinished or backwards."""
    ms = F.unix_millis(col(completed).cast("timestamp")) - F.unix_millis(col(started).cast("timestamp"))
    sec = F.floor((ms + 500) / 1000).cast("long")
    minutes, rest = F.floor(sec / 60).cast("string"), (sec % 60).cast("string")
    return F.when(ms >= 0, F.when(sec >= 60, F.concat(minutes, F.lit("m "), rest, F.lit("s"))).otherwise(F.concat(sec.cast("string"), F.lit("s"))))


def is_true(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def quantity(c, digits: int = 3) -> Column:
    """A number from text or number, 0 when it isn't one."""
    return F.coalesce(col(c).try_cast(f"decimal(23,{digits})"), F.lit(0).cast(f"decimal(23,{digits})"))


def leading_number(c) -> Column:
    """The number a text begins with ('12abc' is 12), else null."""
    return blank_null(F.regexp_extract(col(c), r"^\s*([+-]?\d+(?:\.\d+)?)", 1)).try_cast("double")


def confidence(c) -> Column:
    n = leading_number(col(c).cast("string"))
    return F.when(n > 1, n / 100).otherwise(n)


def open_quantities(po_qty, asn_received, asn_posted, open_qty, old_received, old_posted) -> Column:
    """struct(received, posted, open): from deliveries if there are any, else from the source's open quantity, else as before."""
    zero, qty = F.lit(0).cast("decimal(23,3)"), quantity(po_qty)
    floor = lambda x: F.greatest(zero, x.cast("decimal(23,3)"))
    triple = lambda r, p, o: F.struct(r.cast("decimal(23,3)").alias("received"), p.cast("decimal(23,3)").alias("posted"), o.cast("decimal(23,3)").alias("open"))
    received, posted = floor(quantity(asn_received)), floor(quantity(asn_posted))
    was = quantity(old_posted)
    return (
        F.when(col(asn_received).isNotNull(), triple(received, posted, floor(qty - posted)))
        .when(col(open_qty).isNotNull(), triple(floor(qty - quantity(open_qty)), zero, floor(qty)))
        .otherwise(triple(quantity(old_received), was, floor(qty - was)))
    )


def lead_days(start, end) -> Column:
    """Days from start to end, rounded up."""
    return F.ceil((F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(86_400_000_000))


def excel_day(c) -> Column:
    return F.datediff(F.to_date(col(c)), F.lit("1899-12-30").cast("date"))


def date_number(c) -> Column:
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def delivery_bucket(c, as_of: str) -> Column:
    """overdue, next7, next14, next30, beyond30 or noDate."""
    days = F.datediff(F.to_date(col(c)), F.lit(as_of).cast("date"))
    return F.when(days.isNull(), "noDate").when(days < 0, "overdue").when(days <= 7, "next7").when(days <= 14, "next14").when(days <= 30, "next30").otherwise("beyond30")


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def let(value, body) -> Column:
    """body of a value that is worked out once, however often body names it; a column alone would be copied to every place."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def _dated() -> tuple[str, str]:
    """One pattern for all written dates, of which at most one form fits a text, and the replacement that brings any of them to
    year|month|day|hour|minute|second| (empty where there is none)."""
    clock = r"[ T,]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?"
    # each form with the places of year, month and day among its groups; a clock's three follow them
    forms = [
        (r"(\d{4})-(\d{2})-(\d{2})", (0, 1, 2), clock), (r"(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})", (2, 1, 0), clock), (r"([A-Za-z]{3,9})\.? (\d{1,2}), ?(\d{4})", (2, 0, 1), clock), (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (2, 1, 0), clock),
        (r"(\d{4})(\d{2})(\d{2})", (0, 1, 2), ""), (r"(\d{4})-(\d{1,2})-(\d{1,2})", (0, 1, 2), ""), (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (2, 1, 0), ""), (r"(\d{4})/(\d{1,2})/(\d{1,2})", (0, 1, 2), ""),
        (r"(\d{1,2}) ([A-Za-z]{3,9})\.? (\d{4})", (2, 1, 0), ""), (r"([A-Za-z]{3,9})\.? (\d{1,2}), ?(\d{4})", (2, 0, 1), ""), (r"(\d{1,2})-([A-Za-z]{3,9})-(\d{4})", (2, 1, 0), ""),
    ]
    parts, patterns, at = [""] * 6, [], 1
    for date, places, time in forms:
        patterns.append(date + time)
        for i, place in enumerate(places):
            parts[i] += f"${at + place}"
        for i in range(3 if time else 0):
            parts[3 + i] += f"${at + 3 + i}"
        at += 6 if time else 3
    return "^(?:" + "|".join(patterns) + ")$", "|".join(parts) + "|"


DATED, DATE_PARTS = _dated()


def timestamp(c) -> Column:
    """A source timestamp in any of the forms that sources send, as wall-clock time in UTC; else null.

    /Date(ms)/ and epoch milliseconds, ISO with and without offset, yyyymmdd, yyyy-mm-dd, yyyy/m/d, d.m.yyyy [h:m[:s]],
    d Mon yyyy [h:m[:s]], Mon d, yyyy [h:m] and d-Mon-yyyy. A day beyond the month's end runs on into the next month.
    """
    months = F.array(*map(F.lit, MONTHS))

    def written(p: Column) -> Column:
        number = lambda i: F.coalesce(blank_null(F.get(p, F.lit(i))).try_cast("int"), F.lit(0))
        month = F.get(p, F.lit(1))
        month = F.when(month.rlike(r"^\d"), month.try_cast("int")).otherwise(F.array_position(months, F.lower(F.substring(month, 1, 3))).cast("int"))
        seconds = number(3) * 3600 + number(4) * 60 + number(5)
        return let(F.make_date(number(0), let(month, lambda m: F.when(m.between(1, 12), m)), F.lit(1)), lambda first: F.timestamp_seconds(F.unix_date(F.date_add(first, number(2) - 1)).cast("long") * 86400 + seconds))

    def read(t: Column) -> Column:
        return F.coalesce(
            F.when(t.rlike(DATED), let(F.split(F.regexp_replace(t, DATED, DATE_PARTS), r"\|"), written)),
            F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), t.try_cast("timestamp")),
            F.timestamp_millis(F.coalesce(blank_null(F.regexp_extract(t, r"^/Date\((-?\d+)", 1)).try_cast("long"), F.when(t.rlike(r"^-?\d{11,14}$"), t.try_cast("long")))),
        )

    return let(F.trim(col(c).cast("string")), read)


def clock_time(c) -> Column:
    """'HH:mm:ss' from PT#H#M#S, HH:mm[:ss] or HHmmss; else null."""
    t = F.trim(col(c).cast("string"))
    part = lambda p: F.lpad(F.coalesce(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.lit("0")), 2, "0")
    iso = F.when(t.rlike(r"^PT(?=\d)"), F.concat_ws(":", part(r"(\d+)H"), part(r"(\d+)M"), part(r"(\d+)(?:\.\d+)?S")))
    plain = F.when(t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.concat(part(r"^(\d{1,2}):"), F.lit(":"), part(r"^\d{1,2}:(\d{2})"), F.lit(":"), part(r":\d{2}:(\d{2})$")))
    return F.coalesce(iso, plain, F.when(t.rlike(r"^\d{6}$"), F.regexp_replace(t, r"^(\d\d)(\d\d)(\d\d)$", "$1:$2:$3")))


def date_and_time(date, time) -> Column:
    """The day of one source text at the time of another; the date as it stands without a time."""
    day, clock = timestamp(date), clock_time(time)
    return F.when(clock.isNull(), day).otherwise(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock), "yyyy-MM-dd HH:mm:ss"))


def trailing_window(as_of: str, since: str | None = None, until: str | None = None, days: int = 30) -> tuple[str, str]:
    """(first, last) day: as asked for, missing or unreadable sides from the `days` days that end with as_of, in order."""
    from datetime import date, timedelta

    def day(x):
        try:
            return date.fromisoformat(x) if x and len(x) == 10 else None
        except ValueError:
            return None

    last = date.fromisoformat(as_of)
    a, b = day(since) or last - timedelta(days=days - 1), day(until) or last
    return min(a, b).isoformat(), max(a, b).isoformat()


def differs(pairs) -> Column:
    """Whether any of the pairs (a, b) differs, null being a value."""
    return reduce(lambda x, y: x | y, [~col(a).eqNullSafe(col(b)) for a, b in pairs])


def schedule_timing(pattern, value, cron) -> Column:
    """struct(pattern, value): CRON where no pattern is given, and then the older column's expression where no value is."""
    kind, v = first_text(pattern, F.lit("CRON")), F.coalesce(F.trim(col(value)), F.lit(""))
    return F.struct(kind.alias("pattern"), F.when((v == "") & (kind == "CRON"), F.coalesce(F.trim(col(cron)), F.lit(""))).otherwise(v).alias("value"))


def schedule_error(pattern, value) -> Column:
    """What is wrong with a schedule, else null: CRON has five fields at least, REPEAT_INTERVAL a number from 1 and a unit from
    minutes to weeks, REPEAT_AT three characters at least, ONE_TIME a date or at least a digit at first."""
    kind, v = first_text(pattern, F.lit("CRON")), F.coalesce(F.trim(col(value)), F.lit(""))
    shape, unit = r"^(\d+)\s+(\w+)$", F.lower(F.regexp_extract(v, r"^(\d+)\s+(\w+)$", 2))
    interval = (
        F.when(~v.rlike(shape), "interval needs a number and a unit").when(F.regexp_extract(v, shape, 1).try_cast("decimal(38,0)") < 1, "interval must be at least 1")
        .when(~unit.isin(*[x for u in ("minute", "hour", "day", "week") for x in (u, u + "s")]), "unit must be minutes, hours, days or weeks")
    )
    return (
        F.when(~kind.isin("CRON", "REPEAT_INTERVAL", "REPEAT_AT", "ONE_TIME"), "unknown pattern").when(v == "", "no value").when((kind == "CRON") & (F.size(F.split(v, r"\s+")) < 5), "cron needs five fields")
        .when(kind == "REPEAT_INTERVAL", interval).when((kind == "REPEAT_AT") & (F.length(v) < 3), "time is too short").when((kind == "ONE_TIME") & timestamp(v).isNull() & ~v.rlike(r"^\d"), "no date")
    )


def name_error(name) -> Column:
    """What is wrong with a schedule's name, else null: letters, digits and spaces, 100 at most."""
    t = F.trim(col(name))
    return F.when(F.coalesce(t, F.lit("")) == "", "no name").when(F.length(t) > 100, "longer than 100").when(~t.rlike("^[A-Za-z0-9 ]+$"), "letters, digits and spaces only")
