"""The pipeline's stages: decisions take effect, columns stay, odd rows and empty tables pass through."""

import random

import pytest

import corpus_pipeline
from fraylens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(100, 420):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(90, 150))]
        if i % 4 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "vermin", "rascal"]))
        docs.append((i, " ".join(words), "en", 0.5, True, "d", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = next(t for i, t, *_ in docs if i == 101)
    docs += [(1000, clean, "en", 0.5, True, "d", 1), (1001, clean.upper(), "en", 0.5, True, "d", 1), (1002, clean.replace(" ", "  ", 3) + " end", "en", 0.5, True, "d", 1),
             (1003, clean[:200] + " reach me at joe@site.org today " + " ".join(rng.choice(vocabulary) for _ in range(90)), "en", 0.5, True, "d", 1)]
    spark.createDataFrame(docs, odd.schema).unionByName(odd).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    toxic = {i for i in range(100, 420) if i % 4 == 0}
    assert len(toxic & set(ids["toxicity"])) <= 4 and len(set(ids["toxicity"]) & (set(range(100, 420)) - toxic)) >= 230
    assert {3, 4, 5}.isdisjoint(ids["quality-rules"])  # no words
    left = ids["near-copies"]
    assert len(left) == len(set(left)) and 101 in left and {1000, 1001, 1002}.isdisjoint(left) and 1003 in left
    assert sorted(map(str, ids["pii"])) == sorted(map(str, left))
    by_id = {r["doc_id"]: r for r in seen["pii"]}
    assert "joe@site.org" not in by_id[1003]["text"] and "[EMAIL]" in by_id[1003]["text"] and by_id[1003]["n_chars"] == len(by_id[1003]["text"])
    assert set(ids["packing"]) == set(left)


def test_stages_of_nothing(spark, folder, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(QUERIES) <= set(names)


CLASHES = "wide string, spans string, base_email string, base_phone string, host string, verdict string, sequence_id string, offset int, __block int, label string, digest string, r string"


def test_columns_of_any_name_pass_through(spark, folder):
    """Stages use none of a table's own columns and leave them as they are; what is redacted is in no column."""
    names = [c.split()[0] for c in CLASHES.split(", ")]
    rng = random.Random(3)
    words = lambda: " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(60))
    rows = [(i, f"{words()} joe{i}@site.org {words()}", *[None if c in ("offset", "__block") else f"own {c}" for c in names]) for i in range(101, 160, 2)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        assert got
        if name != "packing":
            assert out.dtypes == docs.dtypes
            assert all(r[c] == (None if c in ("offset", "__block") else f"own {c}") for r in got for c in names)
        if name == "pii":
            assert all("[EMAIL]" in r["text"] and "@site.org" not in str(r) for r in got)
