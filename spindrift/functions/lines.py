"""Lines of files, and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By name, the lines from and to, relative to a hit, that an analysis looks at.
FRAMES = {
    "source": (-14, 0), "sanitizer": (-19, 0), "custom_sanitizer": (-29, 0), "auth": (-49, 0), "safe_context": (-9, 5), "file_boost": (-14, 3), "sql_nearby": (-2, 2), "multiline": (0, 14), "surrounding": (-5, 5), "features": (-19, 10),
    "feature_source": (-29, 0), "tfidf": (-9, 10), "closure": (-9, 0), "dead_code": (-4, -1), "inline_sanitizer": (-49, -1), "file_guard": (-19, 0), "internal_source": (-99, -1), "hardcoded_url": (-19, 5), "advanced_sanitizer": (-9, 0),
    "advanced_validation": (-14, 0), "auth_context": (-99, 0), "custom_function": (-19, 0), "ml_filter": (-9, 10), "fast_verify": (-2, 3),
}


def explode_lines(files: DataFrame, code_col: str = "code") -> DataFrame:
    """A row for each line, with line_no from 1 and text, without the code itself."""
    rest = [c for c in files.columns if c != code_col]
    out = files.select(*rest, F.posexplode(F.split(F.col(code_col), "\n", -1)).alias("pos", "text"))
    return out.select(*rest, (F.col("pos") + 1).alias("line_no"), "text")


def ordered(key: str = "file_id") -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def frame(name: str, key: str = "file_id"):
    return ordered(key).rowsBetween(*FRAMES[name])


def context(name: str, key: str = "file_id", text: str = "text") -> Column:
    """The lines of a frame as one text."""
    return F.array_join(F.collect_list(text).over(frame(name, key)), "\n")


def seen(test: Column, name: str, key: str = "file_id") -> Column:
    """Whether any line of a frame passes the test; cheaper than the text where the test can't span lines."""
    return F.coalesce(F.max(test.cast("int")).over(frame(name, key)), F.lit(0)) == 1


def counted(text: Column, what: str) -> Column:
    """How often a string occurs in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def brace_depth(key: str = "file_id") -> Column:
    """Braces open after a line, never below zero."""
    open_ = F.sum(counted(F.col("text"), "{") - counted(F.col("text"), "}")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0))
    return F.greatest(F.lit(0), open_)


def in_comment(key: str = "file_id") -> Column:
    """Whether a line is a comment line, or an earlier line has opened a comment that isn't closed yet."""
    t = F.trim(F.col("text"))
    marker = F.when(t.contains("*/"), 0).when(t.contains("/*"), 1)
    before = F.last(marker, ignorenulls=True).over(ordered(key).rowsBetween(Window.unboundedPreceding, -1))
    return t.startswith("//") | t.startswith("#") | t.startswith("*") | (F.coalesce(before, F.lit(0)) == 1)


def in_html(key: str = "file_id", opening: str = "<?php", closing: str = "?>") -> Column:
    """Whether a line stands outside of code: the last line up to it whose opening and closing tags differ in number closes."""
    o, c = counted(F.col("text"), opening) / len(opening), counted(F.col("text"), closing) / len(closing)
    state = F.when(o != c, (o > c).cast("int"))
    return F.coalesce(F.last(state, ignorenulls=True).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 0


def function_extents(lines: DataFrame, key: str = "file_id", start: str = r"(?i)\bfunction\s+\w+") -> DataFrame:
    """(key, name, start_line, end_line): a function ends at the first line with a closing brace, from its own on, after which no more braces are open than before it.

    Such a line closes each level from the one after it to the one before it. So it has a row for each of these, no more
    than it has braces, and one for the case that it has as many of both; starts look for the next row of their level.
    """
    depth = lines.withColumn("depth", brace_depth(key)).withColumn("before", F.coalesce(F.lag("depth").over(ordered(key)), F.lit(0)))
    none = F.lit(None).cast("string")
    starts = depth.where(F.col("text").rlike(start)).select(key, F.regexp_extract("text", r"(?i)\bfunction\s+(\w+)", 1).alias("name"), "line_no", F.col("before").alias("level"))
    closing = depth.where(F.col("text").contains("}")).select(key, none.alias("name"), "line_no", F.explode(F.sequence("depth", F.greatest("depth", "before"))).alias("level"))
    back = Window.partitionBy(key, "level").orderBy(F.desc("line_no"), F.asc_nulls_first("name")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.last(F.when(F.col("name").isNull(), F.col("line_no")), ignorenulls=True).over(back)
    return starts.unionByName(closing).withColumn("end_line", end).where("name IS NOT NULL").select(key, "name", F.col("line_no").alias("start_line"), "end_line")


def match_lines(files: DataFrame, pattern: str, key: str = "file_id", code_col: str = "code") -> DataFrame:
    """(key, ord, line_no) of each match of a pattern that holds no newline: matches of each line, numbered by a running sum over the file's lines."""
    lines = explode_lines(files.select(key, code_col), code_col)
    found = lines.select(key, "line_no", (F.size(F.split("text", pattern, -1)) - 1).alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(ordered(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before.cast("int")).select(key, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("ord"), "line_no")
