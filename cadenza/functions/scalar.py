"""Column expressions: pitch, grammar and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza import catalog


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69.0) / 12.0)


def signed_frequency(frequency: Column, voicing: Column) -> Column:
    """Negative where unvoiced or not above zero; 0 stays 0. Missing values: frequency 0, voiced."""
    f, v = F.coalesce(frequency, F.lit(0.0)), F.coalesce(voicing, F.lit(True))
    return F.when(~v | (f <= 0), -F.abs(f)).otherwise(f)


def interval_end(start: Column, duration: Column) -> Column:
    return start + duration


def is_chord(value: Column) -> Column:
    return value.rlike(catalog.CHORD)


def is_key(value: Column) -> Column:
    return value.rlike(catalog.KEY_MODE)


def is_media_id(value: Column) -> Column:
    return value.rlike(catalog.MEDIA_ID)


def is_version(value: Column) -> Column:
    return value.rlike(catalog.VERSION)


def is_id(value: Column) -> Column:
    return value.rlike(catalog.ID)


def registry_key(version: Column) -> Column:
    """'v1' for versions of the first series, null for others."""
    return F.when(version.rlike(catalog.VERSION_LOOSE), "v1")


def intervals_from_points(df: DataFrame, time: str = "extent_time", by: str = "annotation", order: str = "obs_index") -> DataFrame:
    """df without each group's last point, with `until`: the next point's time."""
    return df.withColumn("until", F.lead(time).over(Window.partitionBy(by).orderBy(order))).where("until is not null")


def levels(df: DataFrame, level: str = "payload_level", by: str = "annotation") -> DataFrame:
    """The distinct levels of each group in ascending order."""
    return df.groupBy(by).agg(F.sort_array(F.collect_set(level)).alias("levels"))


def by_level(df: DataFrame, level: str = "payload_level", label: str = "payload_label", by: str = "annotation", order: str = "obs_index") -> DataFrame:
    """The labels of each group's levels, in the order of the observations."""
    rows = F.array_sort(F.collect_list(F.struct(order, label)))
    return df.groupBy(by, F.col(level).alias("level")).agg(rows.alias("rows")).select(by, "level", F.col(f"rows.{label}").alias("labels"))
