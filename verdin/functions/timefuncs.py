"""Time-axis column functions (X1, X2, X3, X13, X14, J3 parsing).

Wall-clock semantics: datasets carry zone-less timestamps.  All epoch math here
goes through ``timestampdiff`` against a zone-less epoch so the result does not
depend on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# Accepted text layouts for heterogeneous timestamp parsing (tried in order).
DATETIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
)
# Fixed value: the time-of-day pattern (hours:minutes with optional seconds).
TIME_ONLY_PATTERN = r"^\d{1,2}:\d{2}(:\d{2})?$"
# Shape shared by every layout above: a numeric date (time-only text never matches).
DATE_SHAPE = r"^\d{1,4}[-./]\d{1,2}[-./]\d{1,4}"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_ntz(c) -> Column:
    """Zone-less timestamp from a typed timestamp column (NTZ passes through)."""
    return col_of(c).cast(TimestampNTZType())


def parse_timestamp(c) -> Column:
    """Tolerant text → zone-less timestamp: trims, drops a trailing ``Z``,
    tries the fixed layouts in order; blank, null or unparsable → null.
    Pure time-of-day strings are rejected (they would otherwise get today's date)."""
    text = F.regexp_replace(F.trim(col_of(c).cast("string")), r"Z$", "")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATETIME_FORMATS])
    # every accepted layout starts with a numeric date; anything else skips the parsers
    return (F.when(~text.rlike(DATE_SHAPE), F.lit(None))
            .otherwise(parsed.cast(TimestampNTZType())))


def as_timestamp(c, dtype) -> Column:
    """Typed timestamps pass through; text is parsed with :func:`parse_timestamp`."""
    name = dtype.typeName() if dtype is not None else "string"
    if name in ("timestamp", "timestamp_ntz"):
        return to_ntz(c)
    if name == "date":
        return col_of(c).cast(TimestampNTZType())
    return parse_timestamp(c)


def epoch_seconds(c) -> Column:
    """Whole seconds since 1970-01-01 for a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), to_ntz(c))


def epoch_micros(c) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), to_ntz(c))


def from_epoch_seconds(seconds) -> Column:
    return F.timestamp_add("SECOND", col_of(seconds), F.expr(EPOCH_NTZ))


def floor_to(c, seconds: int) -> Column:
    """Truncate a zone-less timestamp to a multiple of ``seconds`` since the epoch."""
    secs = epoch_seconds(c)
    return from_epoch_seconds(F.floor(secs / F.lit(seconds)) * F.lit(seconds))


def weekday0(c) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(to_ntz(c))


def datetime_projection(c, name: str) -> list[Column]:
    """``name__ts`` epoch seconds, ``__hour``, ``__dayofweek`` (Mon=0), ``__month``; null → 0."""
    ts = col_of(c)
    return [
        F.coalesce(epoch_seconds(ts), F.lit(0)).cast("long").alias(f"{name}__ts"),
        F.coalesce(F.hour(ts), F.lit(0)).cast("int").alias(f"{name}__hour"),
        F.coalesce(weekday0(ts), F.lit(0)).cast("int").alias(f"{name}__dayofweek"),
        F.coalesce(F.month(ts), F.lit(0)).cast("int").alias(f"{name}__month"),
    ]


def time_to_minutes(c) -> Column:
    """``h:mm[:ss]`` → h*60 + m + s/60 (no range check); anything else → null."""
    parts = F.split(F.trim(col_of(c).cast("string")), ":")
    n = F.size(parts)
    h = F.try_element_at(parts, F.lit(1))
    m = F.try_element_at(parts, F.lit(2))
    s = F.when(n == 3, F.try_element_at(parts, F.lit(3))).otherwise(F.lit("0"))
    ok = n.isin(2, 3) & h.rlike(r"^[+-]?\d+$") & m.rlike(r"^[+-]?\d+$") & s.rlike(r"^[+-]?\d+$")
    value = (h.cast("long") * 60 + m.cast("long")).cast("double") + s.cast("long") / F.lit(60.0)
    return F.when(ok, value)


def calendar_features(c, prefix: str = "") -> list[Column]:
    """Unix seconds, fractional hour, minute, weekday, day of year, month,
    weekend flag and sine/cosine encodings of hour/24, weekday/7, month/12."""
    ts = col_of(c)
    hour_frac = F.hour(ts) + F.minute(ts) / F.lit(60.0)
    wd = weekday0(ts).cast("double")
    month = F.month(ts).cast("double")
    two_pi = 2.0 * math.pi
    p = prefix
    return [
        epoch_seconds(ts).cast("double").alias(f"{p}timestamp_unix"),
        hour_frac.alias(f"{p}hour"),
        F.minute(ts).cast("double").alias(f"{p}minute"),
        wd.alias(f"{p}dayofweek"),
        F.dayofyear(ts).cast("double").alias(f"{p}dayofyear"),
        month.alias(f"{p}month"),
        (wd >= 5).cast("double").alias(f"{p}is_weekend"),
        F.sin(F.lit(two_pi) * hour_frac / 24.0).alias(f"{p}hour_sin"),
        F.cos(F.lit(two_pi) * hour_frac / 24.0).alias(f"{p}hour_cos"),
        F.sin(F.lit(two_pi) * wd / 7.0).alias(f"{p}weekday_sin"),
        F.cos(F.lit(two_pi) * wd / 7.0).alias(f"{p}weekday_cos"),
        F.sin(F.lit(two_pi) * month / 12.0).alias(f"{p}month_sin"),
        F.cos(F.lit(two_pi) * month / 12.0).alias(f"{p}month_cos"),
    ]


CALENDAR_COLUMNS = ("timestamp_unix", "hour", "minute", "dayofweek", "dayofyear", "month",
                    "is_weekend", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
                    "month_sin", "month_cos")


def record_timestamp(record: Column, keys: list[str], epoch_fields: list[str]) -> Column:
    """Timestamp of a nested record: named keys first, then any ``*__ts`` epoch field."""
    named = [parse_timestamp(record.getField(k)) for k in keys]
    epochs = [from_epoch_seconds(record.getField(k).cast("long")) for k in epoch_fields]
    return F.coalesce(*(named + epochs)) if (named or epochs) else F.lit(None).cast(TimestampNTZType())


# Fields of a record that name its time, in the order in which they are tried.
RECORD_TIME_KEYS = ("timestamp", "datetime", "date", "Дата", "Дата и время")


def record_time_of(df: DataFrame, column: str) -> Column:
    """X14 for a struct column: the fields are found from its schema (the fixed names, then every field ending in ``__ts``)."""
    fields = df.schema[column].dataType.names
    return record_timestamp(F.col(f"`{column}`"), [k for k in RECORD_TIME_KEYS if k in fields], [f for f in fields if f.endswith("__ts")])
