"""Places in texts: lines and sentences with their offsets, what stands in code, and what stands around a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import Text, col

FENCE = r"^\s*(```|~~~)"


def lines(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, no, line, start, end): the lines of each text with their offsets, the line end not in them; null texts have none."""
    listed = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return listed.select(key, "no", "line", start.alias("start"), (start + F.length("line")).cast("long").alias("end"))


def outside_code(numbered: DataFrame, *, key: str) -> DataFrame:
    """The lines that aren't in a fenced block of code, nor its fences; a block that is never closed goes to the end."""
    fence = F.col("line").rlike(FENCE)
    open_before = F.count_if(fence).over(Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("_in", F.coalesce(open_before, F.lit(0)) % 2 == 1).filter(~fence & ~F.col("_in")).drop("_in")


def kinds(numbered: DataFrame, *, key: str) -> DataFrame:
    """Lines with kind: table_row, separator, header (the row before a separator), item, blank or paragraph."""
    row = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    rule = F.col("line").rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$") & F.contains("line", F.lit("|"))
    ruled = numbered.withColumn("_rule", rule)
    before_rule = F.coalesce(F.lead("_rule").over(Window.partitionBy(key).orderBy("no")), F.lit(False))
    kind = (
        F.when(F.col("line").rlike(r"^[\s\x{00A0}\x{200B}\x{3000}]*$"), "blank").when(F.col("_rule"), "separator").when(row & before_rule, "header").when(row, "table_row")
        .when(F.col("line").rlike(r"^\s*([-*•+]|\d+[.)])\s+\S"), "item").otherwise("paragraph")
    )
    return ruled.withColumn("kind", kind).drop("_rule")


def sentence_around(text: Text, at: Column) -> Column:
    """The sentence that the character at `at` (from 1) stands in: from behind the stop or line end before it to the next one."""
    before = F.regexp_extract(F.substring(col(text), F.lit(1), at - 1), r"([^.!?\n]*)$", 1)
    behind = F.regexp_extract(F.substring(col(text), at, F.length(col(text))), r"^([^.!?\n]*[.!?]?)", 1)
    return F.trim(F.concat(before, behind))


def window_around(length: Column, start: Column, end: Column, *, reach: int, most: int) -> Column:
    """Struct (low, high), offsets of a window of `reach` characters around start and end, trimmed to `most` at the edge farther from them."""
    low, high = F.greatest(start - reach, F.lit(0)), F.least(end + reach, length)
    over = F.greatest(high - low - most, F.lit(0))
    left = F.when(start - low >= high - end, F.least(over, start - low)).otherwise(F.greatest(over - (high - end), F.lit(0)))
    return F.struct((low + left).cast("long").alias("low"), (high - (over - left)).cast("long").alias("high"))
