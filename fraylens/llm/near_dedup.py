"""Near copies: sets of distinct five-word shingles with a Jaccard similarity of 0.8 or more, and the groups that such links form.

SimHash fingerprints of the same shingles that differ in at most two bits (``simhash.near_fingerprints``) give the closest pairs; two texts at exactly 0.8
differ in about ten bits, which no small Hamming ball reaches, so the prefix filters of ``ngram_join`` give the rest. Every pair is verified on the
complete sets, groups are exact and complete. A text meets others only through shingles that it shares with few, or through the head of a family,
so neither a passage that many texts share nor a large group of near copies is paired with itself.

Texts without words are copies of each other. Null texts are empty ones. Rows without id belong to their group; repeated rows belong together.
An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.llm import ngram_join, simhash
from fraylens.llm.shared import discard, extended, partitions, stored, text_of

WORDS, PERCENT = 5, 80


def prints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text), node (of equal shingle sets; -1 without words), number of shingles and fingerprint of every row."""
    def run(texts: list[str]) -> dict:
        out: dict = {"node": [], "n_shingles": [], "fp": []}
        for text in texts:
            words = text.encode().lower().split()
            tokens = ngram_join.token_set(text, size)
            out["node"].append(ngram_join.node_of(tokens) if len(tokens) else -1)
            out["n_shingles"].append(len(tokens))
            out["fp"].append(simhash.signed(simhash.majority(simhash.shingle_hashes(words, size))))
        return out

    return extended(docs.withColumn("__digest", F.md5(text_of().cast("binary"))), ("doc_id", "__digest"), "node long, n_shingles long, fp long", lambda: run).withColumnRenamed(
        "__digest", "digest")


def close_pairs(rows: DataFrame) -> DataFrame:
    """a, b: nodes whose fingerprints are equal or differ in at most two bits (of equal ones each with the first)."""
    nodes = rows.where("n_shingles > 0").select("fp", "node").distinct()
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("id")), "near-prints")
    equal = nodes.join(firsts, "fp").where("node != id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(simhash.near_fingerprints(firsts, "near"))


def groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, digest, label of every row: rows with one label are one group of near copies."""
    rows = stored(prints(docs, size), "near-rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // ngram_join.BUCKET))
    sets = stored(ngram_join.shared_sets(docs, size, percent, buckets), "near-sets")
    sure, pairs = ngram_join.candidates(sets, percent)
    close = close_pairs(rows).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(sure.unionByName(ngram_join.verified(pairs.unionByName(close).distinct(), sets, percent)), "near-links")
    discard(sets)
    label = simhash.components(edges, "near")
    return rows.join(label, "node", "left").select("doc_id", "digest", F.coalesce("label", "node").alias("label"))
