"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped by the scoring workers.

Words are counted first. Then tasks count the n-grams of their documents and deal them out by the hash of their context into as many shards
as the text needs; n-grams after a frequent word (one with over 1 / ``SPREAD`` of a shard's share) are dealt by their own hash, so it is
no hot key. A shard's reducer writes sorted arrays of 64-bit hashes with counts to the shared folder and hands on the (n-1)-grams, whose
counts are continuation counts; totals of spread contexts are added up in a step of their own. Scoring maps these arrays and looks up
a batch's distinct n-grams by binary search. Nothing is pruned: the model grows with the text.

Null and empty texts consist of the end token alone. Without training text every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens import session
from fraylens.llm.shared import extended, partitions, shared_path, stored, text_of

#: Words of an n-gram; bytes of text per shard; tokens that a task counts or scores at once.
ORDER, SHARD_BYTES, TOKENS = 2, 8_000_000, 3_000_000
#: Words hold no white space, so these are none.
END, BEGIN = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" begin")
PARTS = "kind string, shard long, payload binary"
DISCOUNTS = 3
#: Counts up to this one take a byte; larger ones stand in an array of their own.
OFTEN = 255
#: A word is frequent if it is more than one in this many of a shard's mean tokens.
SPREAD = 8
COUNTS = ("total", "once", "twice", "more")


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpacked(payloads: pd.Series) -> list[tuple[np.ndarray, ...]]:
    return [pickle.loads(zstandard.ZstdDecompressor().decompress(p)) for p in payloads]


def combine(columns: np.ndarray) -> np.ndarray:
    """One hash of each row of word hashes; a single word's hash is itself."""
    out = columns[:, 0]
    with np.errstate(over="ignore"):
        for c in columns.T[1:]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards hold ranges of hashes: sorted keys have sorted shards."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype("i8")


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, where each first stood, and sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "i8")
    return key[start], order[start], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def deal(kind: str, shard: np.ndarray, *arrays: np.ndarray) -> list[tuple[str, int, bytes]]:
    """Rows of (kind, shard, arrays)."""
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(shard) else []
    return [(kind, int(ranked[a]), packed(*(x[order[a:b]] for x in arrays))) for a, b in zip(start, [*start[1:], len(shard)])]


def compact(values: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def is_spread(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rows whose context has frequent words only (a frequent context is among them)."""
    out = np.ones(len(grams), bool)
    for word in grams[:, :-1].T:
        at = np.searchsorted(frequent, word)
        out &= frequent[np.minimum(at, len(frequent) - 1)] == word
    return out


def home(grams: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram."""
    return np.where(is_spread(grams, frequent), shard_of(combine(grams), shards), shard_of(combine(grams[:, :-1]), shards))


class Hashes(dict):
    """Word hashes, remembered in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Tokens:
    """The tokens of a batch of texts in one array, with ``order - 1`` begin marks in front of each text."""

    def __init__(self, order: int):
        self.order, self.known = order, Hashes()

    def batches(self, texts: pd.Series | list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """first text, text after the last, n-grams (one row per token), text of each token (from 0)."""
        parts, owner, size, first = [], [], 0, 0
        head = [BEGIN] * (self.order - 1)
        for i, text in enumerate(texts):
            words = text.encode().lower().split()
            parts.append(np.array([*head, *map(self.known.__getitem__, words), END], "u8"))
            owner.append(len(words) + 1)
            size += len(words) + 1
            if size >= TOKENS or i == len(texts) - 1:
                n = self.order
                grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, n) for p in parts])
                yield first, i + 1, grams, np.repeat(np.arange(len(owner)), owner)
                parts, owner, size, first = [], [], 0, i + 1


def _save(path: str, **arrays: np.ndarray) -> None:
    """Files appear whole or not at all, and a repeated task writes the same again."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for name, value in arrays.items():
        at = f"{path}.{name}.{uuid.uuid4().hex}"
        with open(at, "wb") as f:
            np.save(f, value)
        os.replace(at, f"{path}.{name}.npy")


@dataclass
class Model:
    path: str
    order: int
    shards: int
    tokens: int  # N
    words: int  # V
    discounts: dict[int, list[float]]
    types: int  # sum of continuation counts of words
    uniform: float  # weight of the uniform distribution below the words
    frequent: np.ndarray  # sorted words whose n-grams are spread over shards


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams counted once to four times; 0.5 where a number is missing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    wanted = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.5, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.5]
    return [float(min(max(d, 0.05), k)) for k, d in enumerate(wanted, 1)]


def of_counts(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, DISCOUNTS).astype("i8")]


def _word_reducer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    word, _, (n,) = summed(*(np.concatenate(c) for c in zip(*unpacked(rows["payload"]))))
    return pd.DataFrame([("word", int(key[0]), packed(word, n), len(word), int(n.sum()))], columns=["kind", "shard", "payload", "words", "tokens"])


def _context_counts(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Context hashes with total count and how many n-grams were counted once, twice and more often."""
    context, _, sums = summed(combine(grams[:, :-1]), n, *((n == k).astype("i8") for k in (1, 2)), (n > 2).astype("i8"))
    return context, sums


def _gram_reducer(path: str, level: int, shards: int, frequent: np.ndarray) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Writes a shard's n-grams and contexts; hands on spread contexts, counts of counts and the next lower n-grams."""
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grams, n = (np.concatenate(c) for c in zip(*unpacked(rows["payload"])))
        gram, at, (n,) = summed(combine(grams), n)
        grams, often = grams[at], n >= OFTEN
        _save(f"{path}/gram{level}/{key[0]}", key=gram, count=np.minimum(n, OFTEN).astype("u1"))
        _save(f"{path}/often{level}/{key[0]}", key=gram[often], count=n[often])
        spread = is_spread(grams, frequent)
        context, counts = _context_counts(grams[~spread], n[~spread])
        _save(f"{path}/context{level}/{key[0]}", key=context, **{c: compact(v) for c, v in zip(COUNTS, counts)})
        context, counts = _context_counts(grams[spread], n[spread])
        out = deal(f"context{level}", shard_of(context, shards), context, *counts)
        lower, at, (m,) = summed(combine(grams[:, 1:]), np.ones(len(n), "i8"))
        # words have one-dimensional payloads, longer n-grams rows of word hashes
        rest = grams[at][:, 1:]
        out += deal(f"gram{level - 1}", home(rest, frequent, shards) if level > 2 else shard_of(lower, shards), rest if level > 2 else lower, m)
        out.append(("stats", 0, packed(np.array([(n == k).sum() for k in (1, 2, 3, 4)]))))
        return pd.DataFrame(out, columns=["kind", "shard", "payload"])

    return reduce


def _context_writer(path: str, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def contexts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, *counts = (np.concatenate(c) for c in zip(*unpacked(rows["payload"])))
        h, _, counts = summed(h, *counts)
        _save(f"{path}/spread{level}/{key[0]}", key=h, **{c: compact(v) for c, v in zip(COUNTS, counts)})
        return pd.DataFrame({"n": [len(h)]})

    return contexts


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts all texts of ``docs`` and writes the model below the shared folder."""
    spark = docs.sparkSession
    path = shared_path(session.work_folder(spark, "kneser-ney"))
    texts = docs.select(text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = int(max(partitions(spark), -(-size // shard_bytes)))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(1)
        for b in batches:
            for _, _, grams, _ in tokens.batches(b["text"]):
                word, _, (n,) = summed(grams[:, 0], np.ones(len(grams), "i8"))
                yield pd.DataFrame(deal("word", shard_of(word, shards), word, n), columns=["kind", "shard", "payload"])

    words = stored(texts.mapInPandas(count_words, PARTS).groupBy("shard").applyInPandas(_word_reducer, f"{PARTS}, words long, tokens long"), "kn-words")
    bar = max((words.agg(F.sum("tokens").alias("n")).first()["n"] or 0) // (SPREAD * shards), 1)

    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for word, n in unpacked(b["payload"]):
                yield pd.DataFrame({"word": word[n > bar].view("i8")})

    # at most SPREAD words per shard
    found = [r["word"] for r in words.select("payload").mapInPandas(often, "word long").collect()]
    frequent = np.sort(np.array([BEGIN, *np.array(found, "i8").view("u8").tolist()], "u8"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(order)
        for b in batches:
            for _, _, grams, _ in tokens.batches(b["text"]):
                _, at, (n,) = summed(combine(grams), np.ones(len(grams), "i8"))
                grams = grams[at]
                # a context's n-grams side by side shrink well
                order_by = np.argsort(grams[:, 0], kind="stable")
                grams, n = grams[order_by], n[order_by]
                yield pd.DataFrame(deal(f"gram{order}", home(grams, frequent, shards), grams, n), columns=["kind", "shard", "payload"])

    parts = texts.mapInPandas(count, PARTS)
    stats: dict[int, list[int]] = {}
    for level in range(order, 1, -1):
        own = parts if level == order else parts.where(F.col("kind") == f"gram{level}")
        parts = stored(own.groupBy("shard").applyInPandas(_gram_reducer(path, level, shards, frequent), PARTS), f"kn-{level}")
        stats[level] = _sum_stats(parts.where(F.col("kind") == "stats"))
        parts.where(F.col("kind") == f"context{level}").groupBy("shard").applyInPandas(_context_writer(path, level), "n long").agg(F.sum("n")).collect()

    def unigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw, more = rows["kind"] == "word", rows["kind"] == "gram1"
        w, n = (np.concatenate(c) for c in zip(*unpacked(rows["payload"][raw])))
        v, m = (np.concatenate(c) for c in zip(*unpacked(rows["payload"][more]))) if more.any() else (w[:0], n[:0])
        word, _, (n, m) = summed(np.concatenate([w, v]), np.concatenate([n, np.zeros(len(m), "i8")]), np.concatenate([np.zeros(len(n), "i8"), m]))
        _save(f"{path}/word/{key[0]}", key=word, count=n, before=m)
        return pd.DataFrame([(len(word), int(n.sum()), int(m.sum()), *(int((m == k).sum()) for k in (1, 2, 3, 4)), int((m > 2).sum()))],
                            columns=["words", "tokens", "types", "n1", "n2", "n3", "n4", "more"])

    fields = ["words", "tokens", "types", "n1", "n2", "n3", "n4", "more"]
    both = words.select("kind", "shard", "payload").unionByName(parts.where(F.col("kind") == "gram1"))
    done = both.groupBy("shard").applyInPandas(unigrams, ", ".join(f"{f} long" for f in fields))
    total = {f: v or 0 for f, v in done.agg(*(F.sum(f).alias(f) for f in fields)).first().asDict().items()}
    stats[1] = [total[f] for f in ("n1", "n2", "n3", "n4")]
    d = {k: discounts(v) for k, v in stats.items()}
    weight = (d[1][0] * total["n1"] + d[1][1] * total["n2"] + d[1][2] * total["more"]) / total["types"] if total["types"] else 1.0
    return Model(path, order, shards, total["tokens"], total["words"], d, total["types"], weight, frequent)


def _sum_stats(rows: DataFrame) -> list[int]:
    """n1 to n4 over all shards, added up in the tasks."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (n,) in unpacked(b["payload"]):
                yield pd.DataFrame([n], columns=["n1", "n2", "n3", "n4"])

    got = rows.mapInPandas(add, "n1 long, n2 long, n3 long, n4 long").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(1, 5))).first()
    return [v or 0 for v in got]


class Arrays:
    """Memory-mapped arrays of one kind; a shard without file is empty."""

    def __init__(self, path: str, shards: int, names: tuple[str, ...]):
        self.path, self.shards, self.names = path, shards, names
        self.open = lru_cache(maxsize=512)(self._open)

    def _open(self, shard: int) -> list[np.ndarray] | None:
        if not os.path.exists(f"{self.path}/{shard}.key.npy"):
            return None
        return [np.load(f"{self.path}/{shard}.{n}.npy", mmap_mode="r") for n in ("key", *self.names)]

    def find(self, keys: np.ndarray, shard: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of each key, zeros where it is not stored. ``shard``: of each key, if not that of its own hash."""
        one, first, back = np.unique(keys, return_index=True, return_inverse=True)
        shard = shard_of(one, self.shards) if shard is None else shard[first]
        order = np.argsort(shard, kind="stable")
        one, shard = one[order], shard[order]
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        out = [np.zeros(len(one)) for _ in self.names]
        start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(one) else []
        for a, b in zip(start, [*start[1:], len(one)]):
            if (arrays := self.open(int(shard[a]))) is None:
                continue
            at = np.searchsorted(arrays[0], one[a:b])
            hit = np.flatnonzero(at < len(arrays[0]))
            hit = hit[arrays[0][at[hit]] == one[a:b][hit]]
            for o, values in zip(out, arrays[1:]):
                o[a + hit] = values[at[hit]]
        return [o[place[back]] for o in out]


class Scorer:
    def __init__(self, model: Model):
        self.model, m = model, model
        self.grams = {k: Arrays(f"{m.path}/gram{k}", m.shards, ("count",)) for k in range(2, m.order + 1)}
        self.often = {k: Arrays(f"{m.path}/often{k}", m.shards, ("count",)) for k in range(2, m.order + 1)}
        self.contexts = {k: Arrays(f"{m.path}/context{k}", m.shards, COUNTS) for k in range(2, m.order + 1)}
        self.spread = {k: Arrays(f"{m.path}/spread{k}", m.shards, COUNTS) for k in range(2, m.order + 1)}
        self.words = Arrays(f"{m.path}/word", m.shards, ("count", "before"))

    def probabilities(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' training counts, and the model's probability of each row's last word after the others."""
        m = self.model
        count, before = self.words.find(grams[:, -1])
        p = m.uniform / (m.words + 1)
        if m.types:
            p = p + np.maximum(before - of_counts(before, m.discounts[1]), 0) / m.types
        p = np.broadcast_to(p, count.shape)
        for k in range(2, m.order + 1):
            own = grams[:, -k:]
            gram, context, at, d = combine(own), combine(own[:, :-1]), home(own, m.frequent, m.shards), m.discounts[k]
            n, = self.grams[k].find(gram, at)
            large = np.flatnonzero(n == OFTEN)
            n[large], = self.often[k].find(gram[large], at[large])
            spread = is_spread(own, m.frequent)
            counts = [np.zeros(len(gram)) for _ in COUNTS]
            for where, arrays in ((~spread, self.contexts[k]), (spread, self.spread[k])):
                for c, found in zip(counts, arrays.find(context[where])):
                    c[where] = found
            total, *by = counts
            known = total > 0
            size = np.where(known, total, 1)
            gamma = sum(x * y for x, y in zip(d, by)) / size
            p = np.where(known, np.maximum(n - of_counts(n, d), 0) / size + gamma * p, p)
        return count, p


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every whole text."""
    def make() -> Callable[[list[str]], dict]:
        tokens, scorer = Tokens(model.order), Scorer(model)

        def run(texts: list[str]) -> dict:
            out: dict = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
            for first, end, grams, owner in tokens.batches(texts):
                count, p = scorer.probabilities(grams)
                size = end - first
                out["n_tokens"].append(np.bincount(owner, minlength=size))
                out["n_known"].append(np.bincount(owner, count > 0, size).astype("i8"))
                out["base_score"].append(np.bincount(owner, np.log10((count + 1) / (model.tokens + model.words + 1)), size))
                out["score"].append(np.bincount(owner, np.log10(p), size))
            out = {name: np.concatenate(parts) for name, parts in out.items()}
            return {**out, "train_tokens": np.full(len(texts), model.tokens), "perplexity": 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)}
        return run

    return extended(docs, keep, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", make)
