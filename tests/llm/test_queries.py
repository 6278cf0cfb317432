"""The registered queries themselves: columns, types and base values on a small folder."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fraylens.llm.queries import QUERIES

COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4": "page_id bigint, host string, path string, rule string, verdict string",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8": "doc_id bigint, fingerprint string, component_id bigint",
    "op9": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op12": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Part of the given tables, small enough for every query."""
    path = str(tmp_path_factory.mktemp("given"))
    for name in ("documents", "labels", "pages", "embeddings"):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (given.limit(150) if name == "documents" else given).write.parquet(f"{path}/{name}.parquet")
    return path


def of(name):
    return next(q for n, q in QUERIES.items() if n.startswith(f"{name}_"))


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(n[2:])))
def test_columns_and_rows(spark, folder, name):
    df = of(name)(spark, folder)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert types.get(c) == kind, (c, types)
    rows = df.collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    if name in ("op1", "op3", "op5", "op6", "op7", "op8", "op9", "op10", "op11"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name == "op1":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    if name == "op4":
        assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count() and {r["verdict"] for r in rows} <= {"allow", "block"}
    if name == "op7":
        assert all(r["n_bytes"] == len(docs[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    if name == "op8":
        assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in rows)
    if name == "op9":
        assert all(r["n_chars"] == len(docs[r["doc_id"]]) for r in rows)
    if name == "op10":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["n_tokens"] == len(docs[r["doc_id"]].encode().lower().split()) + 1 for r in rows)
    if name == "op5":
        assert all(r["n_tokens"] > 0 or not docs[r["doc_id"]].strip() for r in rows) and all(len(r["ids_sha256"]) == 64 for r in rows)
        assert all(r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["n_tokens"] == 0)


def test_token_cache_of_the_session(spark, folder, tmp_path):
    """A named cache is met again: nothing is encoded or appended the second time."""
    spark.conf.set("spark.fraylens.token.cache", str(tmp_path / "cache"))
    try:
        first = {r["doc_id"]: r["n_tokens"] for r in of("op7")(spark, folder).collect()}
        stored = spark.read.parquet(str(tmp_path / "cache"))
        entries = stored.count()
        assert entries == spark.read.parquet(f"{folder}/documents.parquet").select(F.coalesce("text", F.lit(""))).distinct().count()
        assert {r["doc_id"]: r["n_tokens"] for r in of("op7")(spark, folder).collect()} == first
        assert spark.read.parquet(str(tmp_path / "cache")).count() == entries
    finally:
        spark.conf.unset("spark.fraylens.token.cache")
