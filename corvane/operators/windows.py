"""Positional operators: contexts, look-ahead, sections, runs, sliding counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every line end that text files use, as one split pattern.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Blanks that trimming a line takes off: all space separators, as SQL's trim does.
BLANKS = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def lines_of(df: DataFrame, text: str, *keep: str, ends: str = LINE_END, empty: bool = False) -> DataFrame:
    """(keep..., line_no, line): one row per line; the empty piece after a last line end is no line.

    ``ends`` is the pattern of line ends; with ``empty`` an empty text (not a missing one) is one empty line.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), ends)
    parts = F.when(F.lit(empty) & (F.col(text) == ""), parts).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return df.select(*keep, F.posexplode(parts).alias("line_no", "line"))


def _trim(line: str) -> Column:
    return F.btrim(F.col(line), F.lit(BLANKS))


def context(lines: DataFrame, key: str, at: str, line: str, window: int = 2) -> DataFrame:
    """Each line with the trimmed, non-empty lines around it, joined by blanks."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-window, window)
    near = F.collect_list(F.nullif(_trim(line), F.lit(""))).over(w)
    return lines.withColumn("context", F.array_join(near, " "))


def next_present(lines: DataFrame, key: str, at: str, line: str) -> DataFrame:
    """Each line with the next one that isn't blank."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("next_line", F.first(F.when(_trim(line) != "", F.col(line)), ignorenulls=True).over(w))


def collapse_runs(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """First row of each run of equal values."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_first")


def sections(starts: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """Section starts with their ends: the next start, else the number of lines."""
    w = Window.partitionBy(key).orderBy(at)
    return starts.withColumn("end_line", F.coalesce(F.lead(at).over(w), F.col(total)))


def zip_positions(left: DataFrame, right: DataFrame, key: str, order: str, take: str, name: str) -> DataFrame:
    """i-th left row with the i-th right row of the same key, only where both have as many rows."""
    rank = Window.partitionBy(key).orderBy(order)
    size = Window.partitionBy(key)
    a = left.withColumn("_i", F.row_number().over(rank)).withColumn("_n", F.count("*").over(size))
    b = right.select(key, F.row_number().over(rank).alias("_i"), F.count("*").over(size).alias("_n"), F.col(take).alias(name))
    return a.join(b, [key, "_i", "_n"], "left").drop("_i", "_n")


def trailing_count(df: DataFrame, key: str, ts: str, interval: str = "1 hour") -> DataFrame:
    """Rows of the same key in the interval before each row, itself included."""
    micros = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-_micros(interval), 0)
    return micros.withColumn("recent", F.count("*").over(w)).drop("_us")


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def fold_captions(lines: Column) -> Column:
    """Drops a caption line that the last kept line ends with (rolling captions)."""
    return F.aggregate(lines, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) > 0) & F.element_at(kept, -1).endswith(x), kept).otherwise(F.array_append(kept, x)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 24) -> DataFrame:
    """One page of a total order; a page number beyond the ends is clamped."""
    total = df.count()
    last = max(1, -(-total // size))
    at = min(max(1, number), last)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)
