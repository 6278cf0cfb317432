"""The five stages of the corpus pipeline. Each works on all that its predecessor kept and makes its own decision count."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.llm import near_dedup, packing, pii, quality, toxicity
from fraylens.llm.shared import discard, ship, stored, table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, scores 0.5 or more go."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    plain = docs.select(*docs.columns)
    scored = toxicity.score(plain.withColumnRenamed("score", "__own_score"), model, tuple("__own_score" if c == "score" else c for c in docs.columns))
    return scored.where(F.col("score") < 0.5).drop("score").withColumnRenamed("__own_score", "score").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail a base rule or are anomalous go."""
    ship(spark)
    forest, cut = quality.fit(docs, table(spark, folder, "labels"))
    taken = set(quality.COUNTS) | {"base_failed", "kept", "anomaly"}
    other = {c: f"__own_{c}" for c in docs.columns if c in taken}
    judged = quality.judge(docs.withColumnsRenamed(other), forest, cut, tuple(other.get(c, c) for c in docs.columns))
    return judged.where("kept").drop(*taken).withColumnsRenamed({v: k for k, v in other.items()}).select(*docs.columns)


def one_of_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of exact and near copies the row with the smallest doc_id stays (a row without id only if none has one; of equal rows one).

    Null and empty texts are one group. Columns of any name pass through; an empty table stays empty.
    """
    ship(spark)
    groups = near_dedup.groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    chosen = stored(groups.groupBy("label").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("row")).select(
        F.col("row.doc_id").alias("id"), F.col("row.digest").alias("digest")), "near-chosen")
    # rows that can't be told apart by id and text are numbered, the first stays
    times = groups.groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
    again = stored(times.where("rows > 1").select(F.col("doc_id").alias("id"), "digest"), "near-again")
    mine = lambda x: F.col("r.doc_id").eqNullSafe(x["id"]) & (F.md5(text_of("r.text").cast("binary")) == x["digest"])
    rows = docs.select(F.struct("*").alias("r"))
    out = rows.join(chosen, mine(chosen), "left_semi")
    if not again.isEmpty():
        several = out.join(again, mine(again), "left_semi")
        first = several.withColumns({"i": F.col("r.doc_id"), "d": F.md5(text_of("r.text").cast("binary"))}).dropDuplicates(["i", "d"]).select("r")
        out = out.join(again, mine(again), "left_anti").unionByName(first)
    return out.select(*(F.col("r")[c].alias(c) for c in docs.columns))


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars follows the text.

    All columns come out as they went in, whatever their names: the row travels in one struct beside the text that is searched. Null texts stay null,
    repeated rows are redacted alike, an empty table stays empty.
    """
    ship(spark)
    rows = docs.select(F.struct("*").alias("__row"), text_of().alias("__text"))
    found = pii.detect(rows, pii.fit(docs), "__text").select("__row", "__text", "spans")
    any_span = F.size("spans") > 0
    out = found.withColumn("__clean", F.when(any_span, pii.redacted(F.col("__text"), F.col("spans"))).otherwise(F.col("__row")["text"]))
    changed = {"text": F.col("__clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(any_span, F.char_length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row")["n_chars"])
    return out.select(*(changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece of a document with its sequence and place."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality-rules", keep_quality), ("near-copies", one_of_copies), ("pii", redact), ("packing", pack)]

#: Models and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs
