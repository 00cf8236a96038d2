"""Index tables in Markdown lists that are stored one line a row.

The state of a line (section, table) depends on the lines before it in its file.
A file may hold a third of all lines, so it is cut into blocks of lines; each block
is scanned on its own and the state at its start comes from a scan over the one-row
summaries of the blocks before it.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Columns that make a table an index table, as they are called in its header.
COLUMNS = ("api", "description", "auth", "https", "cors")
BLOCK = 8192

# Marks set around escaped characters while a row is split; none of them is a character.
_ESC, _BAR = "\ufdd2", "\ufdd4"


def _marked(line: Column) -> Column:
    """The line with each backslash pair marked, so that what it escapes is seen as text."""
    return F.regexp_replace(line, r"\\([\s\S])", rf"\\{_ESC}$1")


_CELL = r"([^|`\\]*+(?:(?:\\[\s\S]|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)[^|`\\]*+)*+(?:[`\\][\s\S]*)?)\|"
#: Rows with more escapes and code spans are split without a pattern that would nest as deep.
MOST_MARKS = 400


def split_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """df with row (the text in one line, without outer blanks) and cells: those of a table row, trimmed; null where a text has no pipe.

    Pipes after a backslash or between back ticks belong to the text; outer pipes are
    optional; empty cells at the end do not count.
    """
    t = F.col(text)
    other = t.contains("\t") | t.contains("\n") | t.contains("\x0b") | t.contains("\x0c") | t.contains("\r")
    df = df.withColumn("row", F.trim(F.when(other, F.translate(t, "\t\n\x0b\x0c\r", "     ")).otherwise(t)))
    df = df.withColumn("full", F.rtrim("row", F.lit("| ")))
    row, full = F.col("row"), F.col("full")
    df = df.withColumn("inner", _inner(full))
    marked = row.contains("`") | row.contains("\\")
    marks = F.length(row) - F.length(F.replace(F.replace(row, F.lit("`")), F.lit("\\")))
    quick = F.when(marked, F.regexp_extract_all(F.concat("inner", F.lit("|")), F.lit(_CELL), F.lit(1))).otherwise(F.split("inner", r"\|", -1))
    cells = F.when(marked & ((marks > MOST_MARKS) | full.endswith("\\")), _split_long(F.when(full.endswith("\\"), row).otherwise(full))).otherwise(quick)
    df = df.withColumn("cells", F.when(row.contains("|"), F.when(F.replace(F.replace(full, F.lit("|")), F.lit(" ")) == "", F.array().cast("array<string>")).otherwise(F.transform(cells, lambda c: F.trim(c)))))
    return df.drop("full", "inner")


def _inner(full: Column) -> Column:
    """A row without its pipe at the start."""
    return F.when(full.startswith("|"), F.substring(full, F.lit(2), F.length(full))).otherwise(full)


def _split_long(row: Column) -> Column:
    parts = F.split(_marked(row), f"(?<!{_ESC})`")
    safe = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit("|"), F.lit(_BAR))).otherwise(s)), "`")
    cells = F.split(F.regexp_replace(safe, r"^\|", ""), rf"(?<!{_ESC})\|", -1)
    cells = F.transform(cells, lambda c: F.trim(F.translate(c, _BAR + _ESC, "|")))
    filled = F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    return F.slice(cells, 1, filled)


def plain(cell: Column) -> Column:
    """A header cell without marks of emphasis, in lower case."""
    return F.lower(F.trim(F.regexp_replace(cell, r"[`*_]", "")))


def plain_text(cell: Column) -> Column:
    """Markdown as text: of images and links the words, no tags and marks, no escapes, entities as characters, single blanks; null stays null."""

    @F.pandas_udf("string")
    def entities(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    t = F.regexp_replace(cell, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", " "), r"<[^<>]+>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"`|\*\*|__", ""), r"\\([\\|_*`\[\]()<>#])", "$1")
    coded = F.coalesce(t.rlike(r"&#?\w+;"), F.lit(False))  # only such texts leave the JVM
    t = F.when(coded, entities(F.when(coded, t))).otherwise(t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


_SEPARATOR = r"^\s*+\|?+(?:\s*+:?+-++:?+\s*+\|)*+\s*+(?::?+-++:?+\s*+)?+$"
#: Carried states of so many blocks at most are broadcast; they are a few bytes each.
MOST_CARRIED = 200_000


def index_rows(lines: DataFrame, key: str = "line_id", file: str = "file_id", order: str = "line_no", text: str = "raw_line", block: int = BLOCK) -> DataFrame:
    """Rows of the index tables: key, file, order, category, header (names in lower case), cells.

    A row is a line with a pipe between the separator line of a table under the heading
    "## Index" and the next blank line or heading; the next heading of level two ends the
    section, one of level three names the category. A table counts if its header names all
    of COLUMNS, in any order. A null line is blank; lines without a number come first in
    their file; other columns are ignored.

    Lines are read and split once; the result is written to the checkpoint folder, as the
    state that a block starts with comes from the blocks before it.
    """
    base = lines.select(F.col(key).alias("key"), F.col(file).alias("file"), F.col(order).alias("no"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw, bar = F.col("row"), F.col("cells").isNotNull()
    level = F.when(raw.startswith("#"), F.length(F.regexp_extract(F.rtrim("text"), r"^ {0,3}(#{1,6})(?:\s|$)", 1))).otherwise(0)
    title = F.trim(F.regexp_replace(raw, r"^#{1,6}\s*|\s*#*$", ""))
    low = F.lower(raw)
    may_head = F.col("bar")
    for c in reversed(COLUMNS):
        may_head = may_head & low.contains(c)
    base = split_rows(base).withColumn("level", level)
    base = base.select(
        "key", "file", "no", F.coalesce(F.floor(F.col("no") / block), F.lit(-1)).alias("block"), bar.alias("bar"), "level", F.when(F.col("level") > 0, title).alias("title"), (raw == "").alias("blank"),
        F.coalesce(bar & raw.contains("-") & ~raw.contains("[") & raw.rlike(_SEPARATOR), F.lit(False)).alias("sep"), "cells", F.when(bar, raw).alias("row"),
    )
    names = F.transform("cells", plain)
    base = base.withColumn("head", F.when(may_head, F.when(F.size(F.array_intersect(names, F.lit(list(COLUMNS)))) == len(COLUMNS), names))).drop("row")
    w = Window.partitionBy("file", "block").orderBy("no", "key")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast("array<string>")
    ev = base.withColumn("before", F.lag("head").over(w)).withColumn("first", F.row_number().over(w) == 1)
    ev = ev.withColumn("starts", F.col("sep") & F.col("before").isNotNull())
    table = F.when(F.col("starts"), F.col("before")).when(F.col("blank") | (F.col("level") > 0), none)
    section = F.when(F.col("level") == 2, F.when(F.lower("title") == "index", 1).otherwise(0))
    category = F.when(F.col("level") == 3, F.col("title")).when(F.col("level") == 2, "")
    ev = ev.withColumns({"table": F.last(table, True).over(upto), "section": F.last(section, True).over(upto), "category": F.last(category, True).over(upto)})
    ev = ev.withColumn("last", F.row_number().over(Window.partitionBy("file", "block").orderBy(F.desc("no"), F.desc("key"))) == 1)
    keep = F.col("first") | F.col("last") | (F.col("bar") & ~F.col("starts") & (F.col("table").isNull() | (F.size("table") > 0)) & (F.coalesce("section", F.lit(1)) == 1))
    ev = cut(ev.where(keep).select("key", "file", "no", "block", "bar", "sep", "starts", "first", "last", "head", "cells", "table", "section", "category"))
    # what each block leaves to the next one; its first line may close a header that is the last line before
    ends = ev.where("last").select("file", "block", "head", "table", "section", "category")
    firsts = ev.where("first").select("file", "block", "sep")
    whole = Window.partitionBy("file")
    many = ends.withColumn("of", F.count(F.lit(1)).over(whole)).where(F.col("of") > 1).join(firsts.withColumnRenamed("file", "f").withColumnRenamed("block", "b"), F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    by = Window.partitionBy("file").orderBy("block")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("sep"), F.lag("head").over(by))
    many = many.withColumn("own", own).withColumn("left", F.coalesce("table", "own"))
    carry = cut(many.select(F.col("file").alias("f"), F.col("block").alias("b"), "own", F.coalesce("own", F.last("left", True).over(past)).alias("table0"), F.last("section", True).over(past).alias("section0"), F.last("category", True).over(past).alias("category0")))
    carry = F.broadcast(carry) if carry.count() <= MOST_CARRIED else carry
    rows = ev.join(carry, F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")), "left")
    rows = rows.where(F.col("bar") & ~F.col("starts") & ~(F.col("first") & F.col("own").isNotNull()))
    rows = rows.withColumns({"table": F.coalesce("table", "table0"), "section": F.coalesce("section", "section0"), "category": F.coalesce("category", "category0", F.lit(""))})
    rows = rows.where((F.size("table") > 0) & (F.col("section") == 1))
    return rows.select(F.col("key").alias(key), F.col("file").alias(file), F.col("no").alias(order), plain_text(F.col("category")).alias("category"), F.col("table").alias("header"), "cells")
