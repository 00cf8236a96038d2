from pyspark.sql import functions as F

from tessera.operators import markdown, rejects

DOC = r"""# List
| API | Description | Auth | HTTPS | CORS |
|---|---|---|---|---|
| [Decoy](https://d.example | two |

## Index
### Animals
API | Description | Auth | HTTPS | CORS |
:---: | :--- | ---: | --- | --- |
| [Pelican \| Log](https://pelican.example/v1) | Sightings \| by lake `a|b` | No | Yes | Unknown |
| [Broken](https://x.example | text | No | Yes | No |
| [Open](https://x.example/) | a `tick here | No | Yes | No |
| [Short](https://x.example/) | text | No |
line without a bar
| [Ok](http://y.example) | text | `apiKey` | YES | no | | |
| plain | text | No | Yes | No |
| [Host](https:// y.example) | text | No | Yes | No |
| [ ](https://y.example) | text | No | Yes | No |
| [Empty](https://y.example) |  | No | Yes | No |
| [Auth](https://y.example) | text | Maybe | Yes | No |
| [Ctl](https://y.example) | te\x1bxt | No | Yes | No |
|---|---|---|---|---|

| [After](https://y.example | ended by a blank line |
### Weather
| CORS | API | HTTPS | Auth | Description | Added |
|---|---|---|---|---|---|
| Yes | [W](https://w.example/docs) | No | OAuth | Rain | 2025 |
| Yes | [W](https://w.example/docs) | Perhaps | OAuth | Rain | 2025 |
### No table
| [Nowhere](https://y.example | x |
## Other
| API | Description | Auth | HTTPS | CORS |
|---|---|---|---|---|
| [Decoy](https://d.example | two |
""".replace("\\x1b", "\x1b")

WANT = {10: "quoting", 11: "quoting", 12: "column_count", 15: "invalid_value", 16: "invalid_value", 17: "invalid_value", 18: "invalid_value", 19: "invalid_value", 20: "invalid_value", 21: "invalid_value", 28: "invalid_value"}


def lines(spark, docs):
    rows = [(1000 * f + k, f"f{f}", k + 1, x) for f, d in enumerate(docs) for k, x in enumerate(d.split("\n"))]
    return spark.createDataFrame(rows, "line_id long, file_id string, line_no int, raw_line string")


def test_reasons_and_clean_rows(spark):
    df = lines(spark, [DOC])
    got = {r.line_id: r.reason for r in rejects.index_rejects(df).collect()}
    assert got == WANT
    clean = {r.name: r for r in rejects.index_clean(df).collect()}
    assert set(clean) == {"Pelican | Log", "Ok", "W"}
    assert clean["Pelican | Log"].description == "Sightings | by lake a|b"
    assert {n: r.category for n, r in clean.items()} == {"Pelican | Log": "Animals", "Ok": "Animals", "W": "Weather"}
    assert (clean["Ok"].auth, clean["Ok"].https, clean["Ok"].cors) == ("apiKey", "yes", "no")
    assert clean["W"].url == "https://w.example/docs"


def test_blocks_do_not_matter(spark):
    df = lines(spark, [DOC, DOC])
    want = {r.line_id: r.reason for r in rejects.index_rejects(df).collect()}
    assert len(want) == 2 * len(WANT)
    for block in (1, 2, 3, 5):
        rows = markdown.index_rows(df, block=block)
        assert {r.line_id for r in rows.collect()} == {r.line_id for r in markdown.index_rows(df).collect()}, block


def test_nulls_empty_and_extra_columns(spark):
    empty = lines(spark, [DOC]).limit(0)
    assert rejects.index_rejects(empty).count() == 0
    df = lines(spark, [DOC]).withColumns({"cells": F.lit("x"), "header": F.lit(1), "key": F.lit(2), "file": F.lit(None), "section": F.lit("s")})
    odd = df.unionByName(spark.createDataFrame([(None, None, None, None), (9001, "g", None, "| a |"), (9002, None, 3, "x" * 200_000 + "|`" * 50_000)], "line_id long, file_id string, line_no int, raw_line string"), True)
    assert {r.line_id: r.reason for r in rejects.index_rejects(odd).collect()} == WANT


def test_long_row(spark):
    head = "## Index\n| API | Description | Auth | HTTPS | CORS |\n|---|---|---|---|---|\n"
    long = head + "| [A](https://a.example) | " + "word `x|y` \\| " * 30_000 + " | No | Yes | No |"
    assert rejects.index_rejects(lines(spark, [long])).count() == 0
    assert rejects.index_clean(lines(spark, [long])).count() == 1


def test_plain_text(spark):
    df = spark.createDataFrame([(1, r"**A** [b](https://x) <br> &amp; \| `c` <i>d</i>"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.x for r in df.select("k", markdown.plain_text(F.col("t")).alias("x")).collect()}
    assert got == {1: "A b & | c d", 2: None, 3: ""}
