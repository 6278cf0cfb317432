"""Text search, suggestions, facets and term statistics with built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z]{3,}"


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs (case-insensitive, not overlapping)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    gone = F.replace(low, F.lit(term.lower()), F.lit(""))
    return ((F.length(low) - F.length(gone)) / F.lit(len(term))).cast("long")


def relevance(fields: dict[str, float], terms: Sequence[str]) -> Column:
    """Sum of field weight x occurrences over all fields and terms."""
    score = F.lit(0.0)
    for name, weight in fields.items():
        for term in terms:
            score = score + occurrences(F.col(name), term) * F.lit(float(weight))
    return score


def highlight(text: Column, terms: Sequence[str]) -> Column:
    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def text_search(
    df: DataFrame, query: str, fields: dict[str, float], key: str, limit: int = 50, offset: int = 0, marked: str | None = None
) -> DataFrame:
    """Best matches over whole texts with score and total number of hits; marks only the returned rows."""
    terms = query.split()
    hits = df.withColumn("score", relevance(fields, terms)).filter("score > 0")
    total = hits.agg(F.count("*")).scalar()
    page = hits.orderBy(F.desc("score"), key).offset(offset).limit(limit).withColumn("total_count", total)
    return page.withColumn("highlight", highlight(F.col(marked), terms)) if marked else page


def scoped_search(
    frames: dict[str, tuple[DataFrame, str, str]], query: str, scope: str = "all", limit: int = 50
) -> DataFrame:
    """Search several kinds at once: {kind: (rows, id column, title column)}, or one of them as ``scope``."""
    kinds = list(frames) if scope == "all" else [scope]
    out = None
    for kind in kinds:
        df, key, title = frames[kind]
        hits = df.withColumn("score", relevance({title: 1.0}, query.split())).filter("score > 0").select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(title).alias("title"), "score")
        out = hits if out is None else out.unionByName(hits)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)


def fuzzy_search(df: DataFrame, column: str, query: str, threshold: float = 0.8, max_edits: int = 2) -> DataFrame:
    """Rows within ``max_edits`` and at least ``threshold`` similar; a length test goes first."""
    text, q = F.lower(column), query.lower()
    size = F.length(column)
    edits = F.levenshtein(text, F.lit(q))
    near = F.abs(size - len(q)) <= max_edits
    return (df.filter(near).withColumn("edits", edits)
            .withColumn("similarity", 1.0 - F.col("edits") / F.greatest(size, F.lit(len(q))))
            .filter((F.col("edits") <= max_edits) & (F.col("similarity") >= threshold)))


def phonetic_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows with a word that sounds like the query."""
    words = F.split(F.col(column), " ")
    return df.filter(F.exists(words, lambda w: F.soundex(w) == F.soundex(F.lit(query))))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def suggest(df: DataFrame, column: str, prefix: str, n: int = 10) -> DataFrame:
    """Most frequent words that start with the prefix."""
    words = df.select(F.explode(terms(F.col(column))).alias("term")).filter(F.col("term").startswith(prefix.lower()))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def suggest_when_few(hits: DataFrame, df: DataFrame, column: str, query: str, least: int = 5) -> DataFrame:
    """Fallback suggestions from the first letters of the query, only when hits are few."""
    few = hits.agg(F.count("*") < least).scalar()
    return suggest(df, column, query[:2]).filter(few)


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of every facet in one pass (grouping sets), as facet, value, n."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    last = len(columns) - 1
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.bitwise_not(F.col("g")).bitwiseAND(F.lit(1 << (last - i))) != 0
        which, value = F.when(here, c).otherwise(which), F.when(here, F.col(c).cast("string")).otherwise(value)
    return sets.select(which.alias("facet"), value.alias("value"), "n")


def popular_terms(rows: DataFrame, text: str, recent: Column, n: int = 20, band: float = 10.0) -> DataFrame:
    """Most frequent terms with growth against the earlier period and up/down/stable."""
    words = rows.select(F.explode(terms(F.col(text))).alias("term"), recent.alias("recent"))
    c = words.groupBy("term").agg(F.count("*").alias("n"), F.count_if("recent").alias("now"), F.count_if(~F.col("recent")).alias("then"))
    growth = F.when(F.col("then") > 0, (F.col("now") - F.col("then")) * 100.0 / F.col("then"))
    return (c.orderBy(F.desc("n"), "term").limit(n).withColumn("growth", growth)
            .withColumn("trend", F.when(growth.isNull() | (growth > band), "up").when(growth < -band, "down").otherwise("stable")))


def term_volume(rows: DataFrame, text: str) -> DataFrame:
    words = rows.select(F.explode(terms(F.col(text))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total_terms"), F.count("*").alias("unique_terms"))


def substring_search(frames: dict[str, tuple[DataFrame, str]], query: str) -> DataFrame:
    """Distinct names per kind that contain the query, ignoring case."""
    out = None
    for kind, (df, column) in frames.items():
        found = df.filter(F.col(column).ilike(f"%{query}%")).select(F.lit(kind).alias("kind"), F.col(column).alias("name")).distinct()
        out = found if out is None else out.unionByName(found)
    return out
