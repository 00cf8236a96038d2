"""Loading rows while malformed ones are set apart with the reason.

Cells are exploded into row, column and value; a rule table is joined by column, each
rule is evaluated on the value, the broken rules of a row are aggregated to the first
reason that holds, and an anti-join leaves the clean rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markdown


class Rule(NamedTuple):
    """A rule on the cells of a column; * is the row as a whole.

    test: match or miss (a pattern), even (a character comes an even number of times),
    pairs (two characters come equally often), width (as many cells as the header has).
    bare: the value is taken without escaped characters. when: a pattern that the value
    has to match for the rule to apply. The broken rule with the lowest rank gives the reason.
    """

    column: str
    rank: int
    reason: str
    test: str
    argument: str = ""
    bare: bool = False
    when: str = ""


# A cell that means to be a link has a bracket, or a parenthesis before an address.
_LINK = r"[\[\]]|\(\s*(?i:https?:|www\.)"
# Characters that can't be shown; only a value with others than printable ASCII needs to be looked through for them.
_BAD, _ODD = r"[\p{Cc}\p{Cs}\p{Cn}\uFFFD]", "[^ -~]"

INDEX_RULES = [
    Rule("*", 1, "quoting", "even", "`", True),
    Rule("api", 1, "quoting", "match", r"^\[.*\]\(.*\)$", True, _LINK),
    Rule("api", 1, "quoting", "pairs", "[]", True, _LINK),
    Rule("api", 1, "quoting", "pairs", "()", True, _LINK),
    Rule("*", 2, "column_count", "width"),
    Rule("api", 3, "invalid_value", "match", r"^\[\s*+\S.*\]\((?i:https?)://[^\s/?#@:]+[^\s]*\)$"),
    Rule("api", 3, "invalid_value", "miss", _BAD, when=_ODD),
    Rule("description", 3, "invalid_value", "match", r"\S"),
    Rule("description", 3, "invalid_value", "miss", _BAD, when=_ODD),
    Rule("auth", 3, "invalid_value", "match", r"^[`\s]*(?i:no|apikey|oauth|x-mashape-key|user-agent)[`\s]*$"),
    Rule("https", 3, "invalid_value", "match", r"^[`\s]*(?i:yes|no)[`\s]*$"),
    Rule("cors", 3, "invalid_value", "match", r"^[`\s]*(?i:yes|no|unknown)[`\s]*$"),
]


def _holds(rule: Rule) -> Column:
    value = F.col("bare" if rule.bare else "value")
    many = lambda ch: F.length(F.replace(value, F.lit(ch)))
    if rule.test == "width":
        holds = F.col("cells_of_row") == F.col("cells_of_header")
    elif rule.test == "even":
        holds = (F.length(value) - many(rule.argument)) % 2 == 0
    elif rule.test == "pairs":
        holds = many(rule.argument[0]) == many(rule.argument[1])
    else:
        holds = value.rlike(rule.argument) if rule.test == "match" else ~value.rlike(rule.argument)
    return holds | ~value.rlike(rule.when) if rule.when else holds


def violations(cells: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key, column, rank, reason for each rule that a cell (key, column, value, bare, cells_of_row, cells_of_header) breaks; a null value breaks every rule of its column. bare is the value without escaped characters.

    rules is a table written by hand (tens of rows), which is why it may be broadcast. Its
    tests become one expression, so that patterns are compiled once and not for each row.
    """
    table = cells.sparkSession.createDataFrame([(k, r.column, r.rank, r.reason) for k, r in enumerate(rules)], "rule int, column string, rank int, reason string")
    judged = cells.join(F.broadcast(table), "column")
    test = reduce(lambda chain, k: chain.when(F.col("rule") == k, _holds(rules[k])), range(len(rules)), F.when(F.lit(False), True))
    return judged.where(~F.coalesce(test, F.lit(False))).select(key, "column", "rank", "reason")


def first_reason(broken: DataFrame, key: str) -> DataFrame:
    """key, reason: of the broken rules of a row, the reason with the lowest rank."""
    return broken.groupBy(key).agg(F.min(F.struct("rank", "reason")).alias("r")).select(key, F.col("r.reason").alias("reason"))


def _cell(name: str) -> Column:
    return F.get("cells", (F.array_position("header", name) - 1).cast("int"))


def index_cells(rows: DataFrame, key: str = "line_id") -> DataFrame:
    """key, column, value, bare, cells_of_row, cells_of_header of the rows of index tables: a row for each of COLUMNS, by the first header cell of the name, and one for the row as a whole (column *)."""
    cells = F.array(F.struct(F.lit("*").alias("column"), F.array_join("cells", "|").alias("value")), *[F.struct(F.lit(n).alias("column"), _cell(n).alias("value")) for n in markdown.COLUMNS])
    each = rows.select(key, F.size("cells").alias("cells_of_row"), F.size("header").alias("cells_of_header"), F.inline(cells))
    bare = F.when(F.col("value").contains("\\"), F.regexp_replace("value", r"\\[\s\S]", "")).otherwise(F.col("value"))
    return each.withColumn("bare", bare)


def rejects_of(rows: DataFrame, key: str = "line_id") -> DataFrame:
    """key, reason of the malformed ones among rows of markdown.index_rows."""
    return first_reason(violations(index_cells(rows, key), INDEX_RULES, key), key)


def index_rejects(lines: DataFrame, key: str = "line_id", **names) -> DataFrame:
    """key, reason of each malformed row of the index tables in lines (see markdown.index_rows)."""
    return rejects_of(markdown.index_rows(lines, key=key, **names), key)


def index_clean(lines: DataFrame, key: str = "line_id", **names) -> DataFrame:
    """The sound rows: key, name, url, description, auth, https, cors, category."""
    rows = markdown.index_rows(lines, key=key, **names)
    sound = rows.join(rejects_of(rows, key), key, "left_anti")
    api = _cell("api")
    tick = lambda n: F.trim(F.replace(_cell(n), F.lit("`")))
    return sound.select(
        key,
        markdown.plain_text(F.regexp_extract(api, r"^\[(.*)\]\(", 1)).alias("name"),
        F.regexp_extract(api, r"\]\(\s*([^()\s]+)", 1).alias("url"),
        markdown.plain_text(_cell("description")).alias("description"),
        tick("auth").alias("auth"),
        F.lower(tick("https")).alias("https"),
        F.lower(tick("cors")).alias("cors"),
        "category",
    )
