"""Scalar expressions: clocks, intervals, probabilities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hms(clock: Column) -> Column:
    """Seconds of an `HH:MM:SS.mmm` clock."""
    part = F.split(clock, ":")
    return F.get(part, F.lit(0)).cast("int") * 3600 + F.get(part, F.lit(1)).cast("int") * 60 + F.get(part, F.lit(2)).cast("double")


def clock(t: Column) -> Column:
    """Signed `mm:ss`, seconds cut off; minutes go beyond 99."""
    whole = F.floor(F.abs(t)).cast("long")
    return F.concat(F.when(t < 0, "-").otherwise(""), F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60))


def overlap(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def apply_platt(p: Column, a: Column, b: Column) -> Column:
    z = F.least(F.greatest(a * logit(p) + b, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(-z))


def seconds(ts: Column, origin: str = "2024-01-01") -> Column:
    """Seconds since origin, as double; both are read in the session's time zone."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(origin + " 00:00:00")))) / 1e6


def one_hot(label: Column, options: list[str]) -> Column:
    """Map from each option to 1.0 if the label is its number and 0.0 if not; null for a null label."""
    pairs = [v for i, o in enumerate(options) for v in (F.lit(o), (label == i).cast("double"))]
    return F.when(label.isNotNull(), F.create_map(*pairs))


def state_for(text: Column, prev: Column | None = None) -> Column:
    """What a scorer is shown: the text, and the text before it if there is any."""
    now = F.create_map(F.lit("narration"), text)
    if prev is None:
        return now
    return F.when(F.coalesce(prev, F.lit("")) != "", F.map_concat(F.create_map(F.lit("previous"), prev), now)).otherwise(now)
