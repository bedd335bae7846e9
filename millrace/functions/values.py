"""Value rules of a copy: normalisation, key text, sizes, names, retry policy and messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Transient error codes of the source and of the destination.
SOURCE_TRANSIENT = (
    3113, 3114, 3135, 12153, 12170, 12514, 12516, 12518, 12519, 12520, 12521, 12528, 12537, 12541, 12543, 12545, 12547, 12560, 12570, 12571, 12582, 50000,
)
TARGET_TRANSIENT = ("57P01", "57P02", "57P03", "53300")
# Parts of messages that tell of a lost connection.
CONNECTION_MESSAGES = ("failed to connect", "tns:packet reader failure")
# Labels of run states, and advice for errors of a read as of an earlier moment.
STATUS_LABELS = {
    "Draft": "Draft", "Pending": "Waiting", "Queued": "Waiting", "Creating": "Preparing", "Planning": "Planning", "Loading": "Copying",
    "Copying": "Copying changes", "Running": "Running", "Validating": "Checking rows", "Paused": "Paused", "Completed": "Finished",
    "CompletedWithErrors": "Finished with errors", "Failed": "Failed", "Cancelled": "Cancelled", "Done": "Done",
}
READ_ADVICE = {1466: "run again in a minute", 1555: "run again, then raise the undo retention", 1591: "resolve the transaction in doubt", 1031: "grant reads of earlier moments"}
FILTER_DENIED = r"(?i);|--|/\*|\*/|\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|exec|execute)\b"


def normalised(c: Column) -> Column:
    """NUL characters go, then an empty string is null."""
    return F.nullif(F.replace(c, F.char(F.lit(0)), F.lit("")), F.lit(""))


def normalise_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: normalised(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def key_text(c: Column, kind: T.DataType) -> Column:
    """A key value as text: numbers plain, dates to the second, binary as hex."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def value_bytes(c: Column, kind: T.DataType) -> Column:
    """Approximate size of a value: strings by characters, binary by bytes, null 0."""
    if isinstance(kind, T.StringType):
        size = F.length(c)
    elif isinstance(kind, T.BinaryType):
        size = F.octet_length(c)
    else:
        size = F.lit({"decimal": 16, "integer": 4, "float": 4, "short": 2, "byte": 1, "boolean": 1}.get(kind.typeName(), 8))
    return F.when(c.isNull(), 0).otherwise(size)


def row_bytes(df: DataFrame) -> Column:
    out = F.lit(0)
    for f in df.schema.fields:
        out = out + value_bytes(F.col(f.name), f.dataType)
    return out.cast("long")


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9_$#]{0,127}$")


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def truncated63(c: Column) -> Column:
    """The longest prefix of whole characters within 63 bytes of UTF-8."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(c), F.lit(63))), lambda n: F.octet_length(F.substring(c, F.lit(1), n)) <= 63)
    return F.substring(c, F.lit(1), F.array_max(fits))


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait before the next attempt."""
    return F.when(attempt <= 1, 30).when(attempt == 2, 60).when(attempt == 3, 120).otherwise(300)


def worth_retrying(source_code: Column, target_state: Column, attempt: Column, stalled: Column, io_failure: Column | None = None, message: Column | None = None) -> Column:
    """Did the connection fail rather than the data? A stalled read or an I/O failure did; then the error's code decides, and its message only where there is no code."""
    source = F.when(source_code == 8103, attempt < 2).otherwise(source_code.isin(*SOURCE_TRANSIENT))
    target = target_state.startswith("08") | target_state.isin(*TARGET_TRANSIENT)
    text = F.lower(F.lit("") if message is None else F.coalesce(message, F.lit("")))
    told = text.contains(CONNECTION_MESSAGES[0]) | text.contains(CONNECTION_MESSAGES[1])
    lost = F.lit(False) if io_failure is None else F.coalesce(io_failure, F.lit(False))
    return F.when(F.coalesce(stalled, F.lit(False)) | lost, True).when(source_code.isNotNull(), source).when(target_state.isNotNull(), target).otherwise(told)


def checked_filter(text: str) -> Column:
    """A user's row filter as a Column; anything that is not one plain expression is refused.

    What stands in quotes is a value or a name and may hold any word or mark.
    """
    plain = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`", "''", text)
    if re.search(FILTER_DENIED, plain) or plain.replace("''", "").count("'") % 2:
        raise ValueError(f"this row filter is not allowed: {text}")
    return F.expr(f"({text})")


def fixed_point(n: Column, unit: int, places: int) -> Column:
    """``n / unit`` with so many decimals, halves up, in whole-number arithmetic."""
    scale = 10**places
    twice = n.cast("long") * (2 * scale) + unit
    parts = ((twice - twice % (2 * unit)) / (2 * unit)).cast("long")
    return F.concat(F.floor(parts / scale).cast("long").cast("string"), F.lit("."), F.lpad((parts % scale).cast("string"), places, "0"))


def human_bytes(n: Column) -> Column:
    """Bytes in the unit that keeps the number small: two decimals from a MB on, one for KB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for least, places, unit in ((1 << 10, 1, "KB"), (1 << 20, 2, "MB"), (1 << 30, 2, "GB")):
        out = F.when(n >= least, F.concat(fixed_point(n, least, places), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNull(), "Unknown").otherwise(out)


def human_age(seconds: Column) -> Column:
    """Time since a figure was taken."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    days = F.floor(s / 86400)
    return (
        F.when(seconds.isNull(), "").when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago"))).when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def human_duration(ms: Column) -> Column:
    """Milliseconds: tenths of a second below ten seconds, whole seconds below a minute, then minutes and seconds."""
    s = F.floor((ms + 500) / 1000).cast("long")
    long = F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))
    return F.when(ms.isNull(), "").when(ms < 10_000, F.concat(fixed_point(ms, 1000, 1), F.lit(" s"))).when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(long)


def human_count(n: Column) -> Column:
    return F.when(n.isNull(), "Unknown").otherwise(F.format_number(n, 0))


def human_size(n: Column, estimate: Column) -> Column:
    """Bytes as in ``human_bytes``, marked where they are an estimate."""
    return F.when(n.isNull(), "Unknown").otherwise(F.concat(F.when(F.coalesce(estimate, F.lit(False)), "~").otherwise(""), human_bytes(n)))


def natural_key(c: Column) -> Column:
    """A text that sorts as people read names: case is ignored, every run of digits counts as a number of any length.

    A number's digits follow their count, so that more digits are a greater number.
    """
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)

    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")


def status_label(c: Column) -> Column:
    """The label of a state; an unknown state is its own label."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), c)
    return F.when(F.coalesce(c, F.lit("")) == "", "—").otherwise(F.coalesce(known, c))


def read_advice(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, text in READ_ADVICE.items():
        out = F.when(code == number, text).otherwise(out)
    return out


def first_line(c: Column, most: int = 500) -> Column:
    return F.left(F.substring_index(c, "\n", 1), F.lit(most))
