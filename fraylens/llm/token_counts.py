"""Token counts with a digest cache: only contents that were never counted are encoded.

A row's key is (digest of the tokenizer file, digest of the normalised content). The tokenizer changes nothing in a text before it
cuts it, so normalising only turns null into the empty text. Keys are joined to the stored counts, one document of each missing
key is encoded, and the new counts are appended to the cache. Rows keep their columns ``doc_id``; null texts count as empty ones,
repeated rows come out as often as they come in, an empty table gives no row, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.llm.shared import stored, text_of, worker_cache
from fraylens.llm.words import load

CACHE = "tokenizer string, digest binary, n_tokens long"
LIMIT = 512
#: White space as the tokenizer's pattern sees it.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


class ChunkCounter:
    """Counts of a byte-level BPE whose tokens hold white space only in front: such a text is the sum of its chunks."""

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer, self.limit, self.known = load(path), limit, {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def count(self, texts: list[str]) -> list[int]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        docs = [None if i in whole else CHUNK.findall(t) for i, t in enumerate(texts)]
        fresh = list({c for d in docs if d for c in d if c not in self.known})
        for at in range(0, len(fresh), 10_000):
            part = fresh[at:at + 10_000]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        get = self.known.__getitem__
        out = [len(self.tokenizer.encode(t, add_special_tokens=False)) if d is None else sum(map(get, d)) for t, d in zip(texts, docs)]
        if len(self.known) > self.limit:
            self.known = {}
        return out


@worker_cache
def counter(path: str) -> ChunkCounter:
    return ChunkCounter(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, one per key even if two runs added the same; none if nothing is stored yet."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("tokenizer", "digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; appends new counts to the Parquet folder ``cache``."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tokenizer": version, "digest": b["digest"], "n_tokens": counter(tokenizer_path).count(b["text"].tolist())})

    text = text_of()
    rows = docs.select("doc_id", text.alias("text"))
    digests = stored(rows.select(
        "doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # one document of each missing content: its id joins back to the texts, so no text is grouped
    missing = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    ids = missing.select(F.col("doc_id").alias("first_id"), F.col("digest").alias("first_digest"))
    texts = keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["first_id"]) & (keyed["digest"] == ids["first_digest"]))
    texts.select("digest", "text").mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    return digests.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
