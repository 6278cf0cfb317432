"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from fraylens.llm import spelling


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words, out = brute_words(rows), {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and brute_near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    rows = spelling.variants(df).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("tile", [2000, 7])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    """Chains of forms, ties, accents, insertions at both ends; tiny tiles cut every block."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng, rows = random.Random(3), []
    vocabulary = ["".join(rng.choice("abcéß") for _ in range(rng.randrange(6, 10))) for _ in range(150)]
    pool = []
    for word in vocabulary:
        pool += [word] * rng.choice([1, 3, 40, 400])
        for _ in range(3):
            at, c = rng.randrange(len(word) + 1), rng.choice("abcé")
            pool += [rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1:], word[:at] + c + word[at + 1:]])] * rng.choice([1, 2, 4, 30])
    rng.shuffle(pool)
    for i in range(0, len(pool), 50):
        rows.append((i, ", ".join(w.title() if rng.random() < 0.1 else w for w in pool[i:i + 50])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert got(df) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != v[0] and v[0] for v in want.values())


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_rows(request, kind):
    docs = request.getfixturevalue(kind)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_very_long_runs(spark):
    rows = [(1, "x" * 30000), (1, "x" * 30000), (2, "x" * 29999 + " y"), (2, "x" * 29999 + " y"), (3, "q" * 4096 + "z" * 4095), (3, "q" * 4096 + "z" * 4095),
            (4, "q" * 4095 + "z" * 4095), (4, "q" * 4095 + "z" * 4095)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
