"""Row operators over whole tables, as DataFrame operations without Python workers.

A table of any size is numbered by a range-partitioned sort, so no task holds a whole table or a whole hot group.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder: a range-partitioned order must not change between two reads."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiloom-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], within: list[str] = (), name: str = "idx") -> DataFrame:
    """df with the place of each row from 0, in all or in its group; ties are in any order.

    Groups are split over the partitions of the sort; only one count for each group and partition meets in one place.
    """
    keys = [*within, *order]
    sorted_ = settled(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    counts = sorted_.groupBy(*within, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*[F.col(c).alias(f"__w_{c}") for c in within], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    same = F.col("__p") == F.col("__q")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    own = F.row_number().over(Window.partitionBy(*within, "__p").orderBy(*order))
    placed = sorted_.withColumn("__own", own).join(begins, same)
    return placed.withColumn(name, (F.col("__begin") + F.col("__own") - 1).cast("long")).select(*df.columns, name)


def render(columns: list[str], with_names: bool = True) -> Column:
    """`name: value` of each column, joined by ` | `; null is empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), v) if with_names else v for c, v in zip(columns, cells, strict=True)])


def _joined(place: str, line: str, by: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), F.col(line)))), lambda x: x[line]), by)


def row_groups(df: DataFrame, order: list[str], columns: list[str], rows_per_chunk: int = 10, include_headers: bool = True, within: list[str] = ()) -> DataFrame:
    """[within,] chunk_index, row_start, row_end (from 1), row_count, content: rows_per_chunk rows a chunk."""
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be greater than 0")
    lines = numbered(df, order, list(within)).select(*within, "idx", render(columns, include_headers).alias("line"), F.expr(f"idx div {rows_per_chunk}").alias("chunk_index"))
    grouped = lines.groupBy(*within, "chunk_index").agg((F.min("idx") + 1).alias("row_start"), (F.max("idx") + 1).alias("row_end"), F.count(F.lit(1)).alias("row_count"), _joined("idx", "line").alias("content"))
    return grouped.select(*within, "chunk_index", "row_start", "row_end", "row_count", "content")


def row_windows(df: DataFrame, order: list[str], line: Column, window_size: int = 5, overlap: int = 1, within: list[str] = (), to_the_end: bool = True, by: str = "\n") -> DataFrame:
    """[within,] window_index, row_start, row_end, row_count, content of every window of window_size rows.

    to_the_end: windows begin while rows are left, so short ones follow; else the first that reaches the end is the last.
    """
    if window_size < 1:
        raise ValueError("window_size must be greater than 0")
    if not 0 <= overlap < window_size:
        raise ValueError("overlap must be less than window_size")
    step = window_size - overlap
    placed = numbered(df.withColumn("__line", line), order, list(within)).select(*within, "idx", "__line")
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - window_size) / step) + 1)
    dealt = placed.select(*within, "idx", "__line", F.explode(F.sequence(first.cast("long"), F.floor(F.col("idx") / step).cast("long"))).alias("window_index"))
    out = dealt.groupBy(*within, "window_index").agg((F.min("idx") + 1).alias("row_start"), (F.max("idx") + 1).alias("row_end"), F.count(F.lit(1)).alias("row_count"), _joined("idx", "__line", by).alias("content"))
    if not to_the_end:
        # a window is needed if it has a row that the window before it has not
        out = out.where((F.col("window_index") == 0) | (F.col("row_end") > (F.col("window_index") - 1) * step + window_size))
    return out.select(*within, "window_index", "row_start", "row_end", "row_count", "content")


def markdown_rows(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """line_no and line of a pipe table: the header, the rule, then the rows."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    body = numbered(df, order).select((F.col("idx") + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join(["---"] * len(columns)) + " |")], "line_no long, line string")
    return head.union(body)


def category_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the column with the fewest distinct values that repeat (the first of those), as name and n."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)], *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cases = F.array(*[F.struct(F.col(f"d{i}").alias("n"), F.lit(i).alias("i"), F.lit(c).alias("name"), (F.col(f"d{i}") < F.col(f"n{i}")).alias("ok")) for i, c in enumerate(columns)])
    best = F.array_min(F.filter(cases, lambda x: x["ok"]))
    return counts.select(best["name"].alias("name"), best["n"].alias("n"))


def as_of(df: DataFrame, order: list[str], value: Column, within: list[str], name: str = "owner") -> DataFrame:
    """df with the last value that isn't null at or before each row of its group.

    One shuffle; a group's rows are sorted and spilled by one task, so groups must not hold a large share of all rows.
    """
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def containing(ranges: DataFrame, points: DataFrame, lo: str, hi: str, at: str, label: str, max_ranges: int = 10_000) -> DataFrame:
    """points with the label of the first range (by lo, then label) that holds `at`; null where none does.

    Up to max_ranges ranges are broadcast, as one sorted array; more are joined by cells as wide as the range.
    """
    n = ranges.limit(max_ranges + 1).count()
    if n <= max_ranges:
        listed = ranges.agg(F.array_sort(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(label).alias("label"), F.col(hi).alias("hi")))).alias("__ranges"))
        joined = points.join(F.broadcast(listed), how="left")
        fits = F.filter("__ranges", lambda r: (r["lo"] <= F.col(at)) & (r["hi"] >= F.col(at)))
        return joined.withColumn(label, F.try_element_at(fits, F.lit(1))["label"]).drop("__ranges")
    # A range of any width is filed under one cell of a power of two that is at least as wide, and under the next if it
    # reaches into that; a point is looked up in its cell of every width that occurs (64 at most).
    power = F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1)).cast("double"))).cast("int")
    sized = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(label).alias("__label"), power.alias("__power"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "__power"))
    cells = sized.withColumn("__cell", F.explode(F.array_distinct(F.array(cell("__lo"), cell("__hi")))))
    powers = [r[0] for r in sized.select("__power").distinct().collect()]
    keyed = settled(points.withColumn("__id", F.monotonically_increasing_id()))
    probes = keyed.select("__id", F.col(at).alias("__at"), F.explode(F.array(*map(F.lit, powers))).alias("__power")).withColumn("__cell", cell("__at"))
    found = probes.join(cells, ["__power", "__cell"]).where((F.col("__lo") <= F.col("__at")) & (F.col("__hi") >= F.col("__at"))).groupBy("__id").agg(F.min(F.struct("__lo", "__label")).alias("__x"))
    return keyed.join(found, "__id", "left").withColumn(label, F.col("__x.__label")).select(*points.columns, label)


def ordered_union(key: str, *parts: DataFrame) -> DataFrame:
    """Rows (key, pos, content) of the parts in turn, numbered anew for each key."""
    tagged = [p.select(key, F.lit(i).alias("__part"), "pos", "content") for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__part", "pos")) - 1).cast("long").alias("chunk_index"), "content")
