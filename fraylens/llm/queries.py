"""The thin registered query of each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens import session
from fraylens.llm import bpe, hard_negatives, kneser_ney, ngram_join, packing, pii, quality, simhash, spelling, spotsigs, token_counts, toxicity, url_filter
from fraylens.llm.shared import remainder, ship, stored, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORDS)


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, *quality.fit(docs, table(spark, folder, "labels")))


@query
def op5_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.digests(docs, WORDS, bpe.build_lexicon(docs, WORDS))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # a cache that stays is named in the session; otherwise each call starts with an empty one
    cache = spark.conf.get("spark.fraylens.token.cache", None) or session.work_folder(spark, "token-cache")
    return token_counts.count_tokens(table(spark, folder, "documents"), cache, BYTES)


@query
def op8_simhash_mih(spark: SparkSession, folder: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, folder, "documents")), "simhash-prints")
    return simhash.link(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    model = kneser_ney.train(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return kneser_ney.score(docs, model).withColumn("held_out", held_out)


@query
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprint_pairs(table(spark, folder, "documents"))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", text_of().alias("text"))
    found = pii.detect(docs, pii.fit(docs))
    base = F.concat(*(f"base_{k}" for k in pii.KINDS))
    return found.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS),
                        F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query
def op11_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(table(spark, folder, "embeddings"))


ORACLE["op11_ngram_jaccard_join"] = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.b, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""

ORACLE["op13_hard_negatives"] = """WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, g.vec_id, g.label, CAST(list_sum(list_transform(list_zip(a.q, g.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT * FROM g WHERE vec_id % 50 = 0) a JOIN g ON g.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
