"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

Words and word beginnings that toxic labelled documents use far more often than others form two lexicons. A text is described by the
densities of lexicon words, how near they stand to words of the second person, capitals, punctuation and obfuscation (letters written
as digits or signs). Trees are fitted and calibrated on out-of-fold features: a document's own label never shapes the lexicon that
describes it. Nothing but the text enters a score. Null and empty texts get the score of a text without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.llm.boosting import Boosted, fit_calibrated
from fraylens.llm.shared import bounded_sample, extended, release, stored, text_of

#: Labelled rows used for fitting at most, folds, and entries of a lexicon at most.
SAMPLE, FOLDS, ENTRIES = 20_000, 4, 4000
#: Occurrences (distinct toxic texts) that an entry needs, and its log-odds for the plain and the strong lexicon.
SUPPORT, PLAIN, STRONG = 3, 1.5, 3.5
STEM = 4
#: Rows of entries that a task holds before it sends them on (and those of one more text).
HELD = 50_000
#: Words of the second person (fixed values).
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
EDGE = ".,;:!?\"'()[]{}<>|#*$%&+=-_~^`/\\"
#: Signs read as the letters they stand for (fixed values).
LEET = str.maketrans("013457@$€!|", "oieastaseil")
FEATURES = ("strong", "plain", "stems", "strong_count", "plain_count", "stem_count", "hidden", "near_second", "second", "capitals", "bangs", "signs", "digits")
STRONG_BIT, PLAIN_BIT, STEM_BIT, HIDDEN_BIT, SECOND_BIT = 1, 2, 4, 8, 16

_CLASS = np.zeros(256, "u1")
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"!?")] = 2
_CLASS[list(b"#*$%&@|<>+=^~_")] = 3
_CLASS[list(b"0123456789")] = 4
_CLASS[list(b" \t\n\x0b\x0c\r")] = 5


def bare(chunk: bytes) -> str:
    return chunk.decode(errors="replace").lower().strip(EDGE)


class Lexicon(dict):
    """Flags of a chunk of text, remembered for as long as memory allows."""

    def __init__(self, strong: frozenset[str], plain: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.strong, self.plain, self.stems = strong, plain, stems

    def flags(self, word: str) -> int:
        return (STRONG_BIT * (word in self.strong)) | (PLAIN_BIT * (word in self.plain)) | (STEM_BIT * (word[:STEM] in self.stems))

    def __missing__(self, chunk: bytes) -> int:
        word = bare(chunk)
        found = self.flags(word)
        if not found and not word.isalpha():
            clear = chunk.decode(errors="replace").lower().translate(LEET).strip(EDGE)
            plain = "".join(c for c in clear if c.isalpha())
            if plain != word and (hidden := self.flags(plain) & (STRONG_BIT | PLAIN_BIT)):
                found = hidden | HIDDEN_BIT
        found |= SECOND_BIT * (word in SECOND)
        if len(self) > 150_000:
            self.clear()
        self[chunk] = found
        return found


def describe(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    flag = np.fromiter(map(lexicon.__getitem__, words), "u1", n)
    of = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=6) if raw else np.zeros(6, "i8")
    hit = np.flatnonzero(flag & (STRONG_BIT | PLAIN_BIT | STEM_BIT))
    second = np.flatnonzero(flag & SECOND_BIT)
    near = 0.0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hit), np.abs(second[np.maximum(at - 1, 0)] - hit))
        near = float((1 / (1 + gap)).sum() / n)
    count = [int(((flag & b) > 0).sum()) for b in (STRONG_BIT, PLAIN_BIT, STEM_BIT, HIDDEN_BIT)]
    size, letters = max(n, 1), max(len(raw) - int(of[5]), 1)
    return [*(c / size for c in count[:3]), *(np.log1p(c) for c in count[:3]), count[3] / size, near, len(second) / size, *(of[i] / letters for i in (1, 2, 3, 4))]


class Model:
    def __init__(self, lexicon: tuple[frozenset[str], frozenset[str], frozenset[str]], trees: Boosted):
        self.lexicon, self.trees = lexicon, trees


def _entries(counts: pd.DataFrame, toxic: float, clean: float, out: int | None) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Lexicons from counts of distinct texts per fold, without fold ``out``."""
    folds = [k for k in range(FOLDS) if k != out]
    p = sum(counts[f"p{k}"].to_numpy() for k in folds)
    q = sum(counts[f"q{k}"].to_numpy() for k in folds)
    odds = np.log((p + 0.5) / (toxic + 1)) - np.log((q + 0.5) / (clean + 1))
    word, stem, support = counts["entry"].to_numpy(object), counts["stem"].to_numpy(bool), p >= SUPPORT
    pick = lambda m: frozenset(word[m].tolist())
    return pick(~stem & support & (odds >= STRONG)), pick(~stem & support & (odds >= PLAIN)), pick(stem & support & (odds >= STRONG))


def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each distinct word and word beginning of each text (text, toxic, fold), in parts: a batch of texts has hundreds of rows a text."""
    release()
    columns = ["entry", "stem", "toxic", "fold"]
    out: list[tuple] = []
    for b in batches:
        for text, toxic, fold in zip(b["text"], b["toxic"], b["fold"]):
            words = {bare(c) for c in set(text.encode().split())} - {""}
            out += [(w, False, toxic, fold) for w in words]
            out += [(s, True, toxic, fold) for s in {w[:STEM] for w in words if len(w) > STEM}]
            if len(out) >= HELD:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From ``labels`` (doc_id, toxic), at most ``sample`` rows of it chosen by hash; a document with several labels has their largest."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(bounded_sample(labels, "doc_id", sample)), "doc_id")
    # equal texts fall into one fold, near copies mostly share their beginning
    rows = stored(rows.groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).withColumn(
        "fold", F.pmod(F.xxhash64(F.substring("text", 1, 40)), F.lit(FOLDS)).cast("int")), "toxic-sample")

    one = lambda label, k: F.sum(F.when((F.col("toxic") == label) & (F.col("fold") == k), 1).otherwise(0)).alias(f"{'qp'[label]}{k}")
    size = rows.groupBy().agg(*(one(v, k) for v in (0, 1) for k in range(FOLDS))).first()
    per_fold = [[size[f"{c}{k}"] or 0 for k in range(FOLDS)] for c in "pq"]
    toxic, clean = sum(per_fold[0]), sum(per_fold[1])
    p, q = (sum((F.col(f"{c}{k}") for k in range(FOLDS)), F.lit(0)) for c in "pq")
    odds = F.log((p + 0.5) / F.lit(toxic + 1.0)) - F.log((q + 0.5) / F.lit(clean + 1.0))
    counted = rows.mapInPandas(entries, "entry string, stem boolean, toxic int, fold int").groupBy("entry", "stem").agg(*(one(v, k) for v in (0, 1) for k in range(FOLDS)))
    counts = counted.where((p >= SUPPORT) & (odds >= PLAIN)).orderBy(F.desc(odds * F.sqrt(p)), "entry", "stem").limit(2 * ENTRIES).toPandas()
    lexicons = {k: _entries(counts, toxic - per_fold[0][k], clean - per_fold[1][k], k) for k in range(FOLDS)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        own = {k: Lexicon(*v) for k, v in lexicons.items()}
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "toxic": b["toxic"], "fold": b["fold"], "x": [describe(t, own[f]) for t, f in zip(b["text"], b["fold"])]})

    got = stored(rows.mapInPandas(measure, "key long, toxic int, fold int, x array<double>"), "toxic-features").toPandas().sort_values("key")
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    return Model(_entries(counts, toxic, clean, None), fit_calibrated(x, got["toxic"].to_numpy(), got["fold"].to_numpy(), trees=60, depth=3))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the calibrated score of every row."""
    def make() -> Callable[[list[str]], dict]:
        lexicon = Lexicon(*model.lexicon)
        return lambda texts: {"score": model.trees.probability(np.array([describe(t, lexicon) for t in texts]).reshape(-1, len(FEATURES)))}

    return extended(docs, keep, "score double", make)
