"""SimHash and SpotSigs against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fraylens.llm import near_dedup, ngram_join, simhash, spotsigs


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_over_random_fingerprints(spark):
    rng = random.Random(5)
    prints = {}
    for i in range(400):  # chains of near fingerprints, many equal ones, and strangers
        base = prints[rng.choice(list(prints))] if prints and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        prints[i + 1] = base
    want = groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in prints.items()], "doc_id long, fp long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.link(df).collect()} == want


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_fingerprints(spark, request, kind):
    docs = request.getfixturevalue(kind)
    got = simhash.link(simhash.fingerprints(docs)).collect()
    assert len(got) == docs.count()
    want = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in docs.collect()}
    assert all(r["fp"] & (1 << 64) - 1 == want[r["doc_id"]] for r in got)
    if kind == "odd":
        label = {r["doc_id"]: r["component_id"] for r in got}
        assert label[1] == label[2] == 1 and label[3] == label[4] == label[5] == 3 and label[6] == 6


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, family = [], {}
    for f in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(5):
            own = list(words)
            for _ in range(c):  # up to four words changed: similarity 0.81 and more
                own[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((f * 10 + c, " ".join(own)))
            family[f * 10 + c] = f
    got = near_groups(spark, dict(rows))
    assert all(family[i] == family[g] for i, g in got.items())
    assert sum(got[i] == min(j for j in got if family[j] == family[i]) for i in got) >= 0.97 * len(got)


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_groups(texts):
    """Groups by links of exact Jaccard similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    return groups(list(texts), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def near_groups(spark, texts):
    """Smallest id of each text's group."""
    rows = near_dedup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    least = {}
    for r in rows:
        least[r["label"]] = min(r["doc_id"], least.get(r["label"], r["doc_id"]))
    return {r["doc_id"]: least[r["label"]] for r in rows}


def test_near_copies_among_texts_of_the_same_words(spark):
    """Texts of the same words in other orders are no copies; copies are far apart by id."""
    rng = random.Random(23)
    words, texts = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)], {}
    for f in range(60):
        own = rng.sample(words, len(words))
        for c in range(3):
            texts[1000 * c + f] = " ".join(own[:150 - 2 * c] + own[150 - 2 * c:][::-1])
    want = jaccard_groups(texts)
    assert len(set(want.values())) == 60
    assert near_groups(spark, texts) == want


def test_near_copies_at_crowded_addresses(spark):
    """All texts share a long passage, so addresses are crowded; copies are far apart by id and differ more from the first text than allowed."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(120)], {}
    for f in range(60):
        tail = [word() for _ in range(80)]
        for c in range(3):
            texts[1000 * c + f] = " ".join(passage + tail[:70] + [word() for _ in range(3 * c)] + tail[70:])
    want = jaccard_groups(texts)
    assert len(set(want.values())) == 60
    assert near_groups(spark, texts) == want


def test_near_copies_are_exact(spark):
    """Pairs on both sides of the similarity, and a line repeated many times, which counts once."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, line = {}, " ".join(word() for _ in range(12))
    for f in range(60):
        own = [word() for _ in range(200)]
        texts[10 * f] = " ".join(own)
        texts[10 * f + 1] = " ".join(own + [word() for _ in range(35 + f // 2)])  # 196 shingles of 231 to 260
    for f in range(20):
        texts[1000 + f] = " ".join([*(word() for _ in range(60)), *[line] * 60])
    want = jaccard_groups(texts)
    assert 20 < sum(want[10 * f + 1] == 10 * f for f in range(60)) < 60
    assert near_groups(spark, texts) == want


def test_texts_under_one_id_are_no_copies(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    rows = near_dedup.groups(spark.createDataFrame([(1, one), (1, two), (2, one + " x"), (3, two + " y"), (None, three), (4, ""), (5, None)], "doc_id long, text string")).collect()
    labels = {(r["doc_id"], r["digest"]): r["label"] for r in rows}
    assert len(labels) == 7 and len(set(labels.values())) == 4


def test_crowded_segments(spark, monkeypatch):
    """Hundreds of fingerprints share one half; pairs within two bits are found on either side of it, and far ones aren't."""
    monkeypatch.setattr(simhash, "CROWDED", 8)
    rng = random.Random(9)
    low, prints = rng.getrandbits(32), []
    for _ in range(60):
        high = rng.getrandbits(32)
        prints.append(high << 32 | low)
        for _ in range(3):
            other = prints[-1]
            for _ in range(rng.randrange(1, 4)):
                other ^= 1 << rng.randrange(64)
            prints.append(other)
    prints = sorted(set(prints))
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 2}
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(prints)], "id long, fp long")
    rows = simhash.near_fingerprints(df).collect()
    assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want) > 60


def test_near_copies_of_a_large_family_and_a_passage(spark):
    """2,000 near copies of one text, and 1,000 texts that share one passage: groups are exact, pairs to compare grow in proportion."""
    def texts(family, sharing):
        rng = random.Random(31)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
        original, passage = [word() for _ in range(150)], [word() for _ in range(120)]
        out = {}
        for i in range(family):
            own = list(original)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(150)] = word()
            out[i] = " ".join(own)
        for i in range(sharing):
            out[100_000 + i] = " ".join([word() for _ in range(rng.randrange(20, 60))] + passage + [word() for _ in range(30)])
        return out

    def pairs(rows):
        docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        sets = ngram_join.shared_sets(docs, 5, 80, 4).cache()
        return ngram_join.candidates(sets, 80)[1].distinct().count()

    assert pairs(texts(2000, 1000)) <= 12 * 3000
    some = texts(300, 150)
    assert near_groups(spark, some) == jaccard_groups(some)


def brute_next(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}


def test_spotsigs_next_and_edit(spark):
    rows = [(i * 7 % 101, f"the stone of number {i} is in a field with moss {i * i} and water " * (i % 5)) for i in range(101)]
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    following = brute_next(rows)
    import hashlib
    for i, text in rows:
        cut = len(text) // 3
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256((text[:len(text) - cut] + following[i][:cut]).encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert all(r["near_edited"] == 1 for r in got.values() if r["fingerprint"] == r["edited_fingerprint"])


def test_spot_signatures():
    assert len(set(spotsigs.ANCHORS)) < 200


def test_spot_chains(spark):
    df = spark.createDataFrame([("The old, stone of the moss WALL was here",), ("zzz yyy",), ("",)], "text string")
    sigs = [r[0] for r in df.select(spotsigs.signatures(F.col("text"))).collect()]
    want = spark.sql("SELECT hash(' old stone') a, hash(' moss wall') b").first()
    assert set(sigs[0]) == {want["a"], want["b"]} and len(sigs[1]) == 1 and sigs[2] == []


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_spotsigs_odd_rows(request, kind):
    docs = request.getfixturevalue(kind)
    got = spotsigs.fingerprint_pairs(docs).collect()
    assert len(got) == docs.count()
    same = [r["fingerprint"] for r in got if r["doc_id"] in (1, 2)]
    assert len(set(same)) <= 1


def test_spotsigs_join(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(60):
        text = " ".join(f"the {rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randrange(1, 40)))
        rows += [(2 * i, text), (2 * i + 1, text + f" of {rng.choice(words)} {rng.choice(words)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect():
        sets.setdefault(tuple(r["s"]), r["doc_id"])
    want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i < j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert {(r["a"], r["b"]) for r in spotsigs.near_copies(df).collect()} == want
