"""Jaccard join of n-gram sets against brute force."""

import random
import re

import pytest

from fraylens.llm import ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


def got(df, percent=90):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(df, percent=percent).collect()), key=str)


def corpus(rng):
    """Families around an original, with and without it, around the threshold; a passage and a line in most texts; chains; copies."""
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = words(60), []
    for size, members, edits in ((110, 110, 3), (60, 90, 2), (140, 20, 4), (12, 8, 1)):
        original = words(size)
        for k in range(members):
            own = list(original)
            for _ in range(rng.randrange(0 if k or size != 60 else 1, edits + 1)):
                at = rng.randrange(len(own))
                own[at:at + rng.randrange(2)] = words(rng.randrange(2))
            texts.append(own)
    for _ in range(90):
        texts.append(words(rng.randrange(5, 80)) + passage + words(rng.randrange(5, 40)))
    chain = words(80)
    for k in range(12):
        texts.append(list(chain))
        chain[k * 6] = rng.choice(vocabulary)
    texts += [words(rng.randrange(1, 60)) for _ in range(60)] + texts[:5]
    rng.shuffle(texts)
    return [(7 * i + 3, " ".join(w.title() if rng.random() < 0.1 else w for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 80)])
def test_components_equal_brute_force(spark, seed, percent):
    rows = corpus(random.Random(seed))
    want = brute(rows, percent)
    assert len({c for _, _, c in want}) < len(rows) - 60
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent) == want


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_rows(request, kind):
    docs = request.getfixturevalue(kind)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_family_is_not_paired_with_itself(spark):
    """Pairs that are left to compare grow with the family, not with its square."""
    def left(members):
        rng = random.Random(5)
        vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
        original, rows = [rng.choice(vocabulary) for _ in range(150)], []
        for i in range(members):
            own = list(original)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((i, " ".join(own)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sets = ngram_join.shared_sets(docs, 3, 90, 4).cache()
        postings = sets.selectExpr("node", "n", "own", "explode(first) as token").where(f"token >= {ngram_join.FREQUENT << 56}")
        links, pairs = ngram_join.family_pairs(ngram_join.families(postings, sets), 90)
        return links.distinct().count(), pairs.distinct().count()

    links, pairs = left(400)
    assert links > 150 and pairs < 8 * 400
    links, pairs = left(1200)
    assert links > 450 and pairs < 8 * 1200
