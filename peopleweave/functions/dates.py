"""Date functions; ``now`` is always a parameter."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def at(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def raw_age_days(ts, now) -> Column:
    return F.floor((F.unix_micros(at(now)) - F.unix_micros(col(ts).cast("timestamp"))) / F.lit(86400000000)).cast("long")


def age_days(ts, now) -> Column:
    days = raw_age_days(ts, now)  # greatest() would turn a missing date into 0, so keep the null
    return F.shiftright(days + F.abs(days), 1)


def relative_label(ts, now) -> Column:
    days = raw_age_days(ts, now)
    return (F.when(days.isNull(), None).when(days <= 0, "今天").when(days == 1, "昨天")
            .when(days <= 7, F.concat(days.cast("string"), F.lit("天前")))
            .when(days <= 30, F.concat(F.floor(days / 7).cast("string"), F.lit("周前")))
            .when(days <= 365, F.concat(F.floor(days / 30).cast("string"), F.lit("个月前")))
            .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("年前"))))


def step_recency(latest_evidence, last_synced, now) -> Column:
    latest = col(latest_evidence)
    days = age_days(F.coalesce(latest, col(last_synced)), now)
    score = (F.when(days <= 7, 100).when(days <= 30, 86).when(days <= 90, 68).when(days <= 180, 46)
             .when(days <= 365, 24).otherwise(8))
    bonus = F.when(latest.isNotNull(), 6).otherwise(0)
    return F.when(days.isNull(), F.lit(0)).otherwise(F.least(F.lit(100), score + bonus))


def recency_multiplier(ts, now) -> Column:
    days = age_days(ts, now)
    return (F.when(days.isNull(), 0.55).when(days <= 30, 1.0).when(days <= 90, 0.85).when(days <= 365, 0.65)
            .otherwise(0.45))


def first_timestamp(*values) -> Column:
    """First value that parses as a timestamp."""
    return F.coalesce(*[F.try_to_timestamp(F.nullif(col(v).cast("string"), F.lit(""))) for v in values])


def date_key(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")
