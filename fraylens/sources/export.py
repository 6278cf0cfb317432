"""Report shapes and file sinks. Nested documents are cut into parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_ROWS = 1000


def parts(children: DataFrame, key: str, payload: Sequence[str | Column], name: str, rows: int = PART_ROWS) -> DataFrame:
    """Children of each key as sorted arrays of about ``rows`` items, numbered by ``part``.

    A key with a million children becomes a thousand parts in as many tasks; nothing is
    left out and no array grows with the group. Equal children are numbered, so that they spread over the parts as well.
    """
    sizes = children.groupBy(key).agg(F.ceil(F.count("*") / rows).alias("__parts"))
    item = F.struct(*payload)
    counted = children.select(key, item.alias("__item")).groupBy(key, "__item").agg(F.count("*").alias("__copies"))
    cut = counted.select(key, "__item", F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).join(sizes, key)
    part = F.pmod(F.xxhash64("__item", "__copy"), F.col("__parts")).alias("part")
    return cut.groupBy(key, part).agg(F.array_sort(F.collect_list("__item")).alias(name))


def documents(encounters: DataFrame, children: DataFrame, key: str, payload: Sequence[str | Column], name: str) -> DataFrame:
    """One JSON document per encounter and part: a slice of its children, and in part 0 the encounter's fields."""
    p = parts(children, key, payload, name)
    d = encounters.join(p, key, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    head = [c if c == key else in_head(c) for c in encounters.columns]
    return d.select(key, "part", F.to_json(F.struct(*head, "part", name)).alias("document"))


def in_head(column: str) -> Column:
    """A field of the whole key: in its part 0 only, so that sums over all parts count it once."""
    return F.when(F.col("part") == 0, F.col(column)).alias(column)


def event_samples(events: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` events per block."""
    from fraylens.operators.metrics import top_per_group
    return top_per_group(events, keys, ["ts", "line_no"], n, "position")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines from the ``document`` column."""
    df.select("document").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sheet(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Rows for a spreadsheet: doubles rounded half-even, everything as text."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.bround(c, digits) if kinds[c] == "double" else F.col(c)).cast("string").alias(c) for c in columns])


def text_report(df: DataFrame, pattern: str, columns: Sequence[str], name: str = "line") -> DataFrame:
    return df.select(F.format_string(pattern, *columns).alias(name))


def markdown_rows(df: DataFrame, columns: Sequence[str], name: str = "line") -> DataFrame:
    """Each row as a line of a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias(name))


def html_rows(df: DataFrame, columns: Sequence[str], name: str = "line") -> DataFrame:
    """Each row as an HTML table row with escaped cells."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))
    return df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")).alias(name))
