"""Relational operators over tables of blocks, chunks, notes and images, as DataFrame operations.

Joins leave the choice of strategy to the planner, which broadcasts by measured size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_notes(refs: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """refs with their notes, by id; references without a note are dropped. A null key has no note."""
    return refs.join(notes, keys, "inner")


def look_up(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the facts of their record, slide or message; null where there are none."""
    return rows.join(facts, keys, "left")


def unknown_names(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The names asked for that are not known."""
    return asked.join(known.select(key).distinct(), key, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order. A partial aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (the smallest of equals) and its count n; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return first_by(counts.withColumn("__less", -F.col("n")), keys, ["__less", value]).drop("__less")


def top_k(df: DataFrame, keys: list[str], value: str, k: int = 3) -> DataFrame:
    """The k most frequent values of each group, as place (from 1), value and n. One row for each value is ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def group_quality(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """n, lo, hi and the upper median of a value's whole numbers in each group.

    The median is taken from counts by value, summed over the values in order: no group's rows meet in one task.
    """
    counts = df.select(*keys, value.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*keys).orderBy("v")
    placed = counts.withColumn("end", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    return placed.groupBy(*keys).agg(F.first("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(F.when(F.col("end") > F.floor(F.col("n") / 2), F.col("v"))).alias("median"))


def with_totals(df: DataFrame, key: str, name: str = "total_chunks") -> DataFrame:
    """df with the number of rows of each key."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)


def page_numbers(df: DataFrame, within: list[str], order: list[str], is_break: Column, name: str = "page") -> DataFrame:
    """df with the page of each row: one more than the breaks before it, its own left out."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, (F.lit(1) + F.coalesce(F.sum(F.when(is_break, 1).otherwise(0)).over(before), F.lit(0))).cast("long"))


def promote_breaks(df: DataFrame, within: list[str], order: list[str], is_break: Column, kept: Column, name: str = "page_break") -> DataFrame:
    """The kept rows, marked if they or a dropped row right after them, before the next kept one, has a break."""
    island = F.sum(F.when(kept, 1).otherwise(0)).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__kept", kept).withColumn("__break", F.coalesce(is_break, F.lit(False))).withColumn("__island", island)
    broken = F.max("__break").over(Window.partitionBy(*within, "__island"))
    return marked.withColumn(name, broken).where("__kept").drop("__kept", "__break", "__island")


def filled_both_ways(df: DataFrame, within: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value at or before each row, or else the first after it."""
    by = Window.partitionBy(*within).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(before, after))


def widest_so_far(df: DataFrame, within: list[str], order: list[str], width: Column, name: str = "widest") -> DataFrame:
    return df.withColumn(name, F.max(width).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def chunk_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chunks with the bytes of the image they name (key and image_name); the first image of a name counts."""
    return chunks.join(first_by(images, ["key", "image_name"], ["position"]), ["key", "image_name"], "inner")
