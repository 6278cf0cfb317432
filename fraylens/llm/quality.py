"""Quality rules, with an isolation forest over the rules' statistics.

Base rules reject a document outright. Of the others the forest tells how few random splits separate a document's statistics from those of
others: short paths are anomalies. Each tree draws its own ``ROWS`` rows from all labelled documents, as isolation forests do. The path length under which
a document is rejected is calibrated on the scores of all labelled documents: it may lose at most ``LOSS`` of the good ones. Null and empty texts have no word and fail the base rules; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.shared import extended, partitions, release, stored

#: Trees of the forest, rows that each of them draws.
TREES, ROWS = 200, 256
#: Part of the good labelled documents that the threshold may reject.
LOSS = 0.01
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED = 8, 20, 0.30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on. Repetition is left to the base rule: good documents with a repeated line are rare, but not bad.
FEATURES = ("symbol_rate", "bang_rate", "upper_rate", "word_length", "distinct_words")

_CLASS = np.zeros(256, "u1")
_CLASS[list(b" \t\n\x0b\x0c\r")] = 1
_CLASS[0x80:0xC0] = 2  # continuation bytes
_CLASS[list(SYMBOLS)] = 3
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 4
_CLASS[list(b"!?")] = 5


def repeated_words(number: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window of words that occurs twice or more. ``number``: words as small integers.

    Windows double in width: two equal halves make an equal whole, so ranks stay exact without hashing.
    """
    rank, width = number, 1
    while width < window:
        step = min(width, window - width)
        if len(rank) <= step:
            return 0
        pair = rank[:-step] * np.int64(len(number) + 1) + rank[step:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        width += step
        if count.max() == 1:
            return 0
    again = (count > 1)[rank]
    cover = np.zeros(len(number) + 1, "i4")
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((cover.cumsum() > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the forest's features of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    of = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=6) if raw else np.zeros(6, "i8")
    chars = len(raw) - int(of[2])
    word_chars = chars - int(of[1])
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    duplicates = len(lines) - len(set(lines))
    if n:
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        number = np.fromiter(map(place.__getitem__, words), "i8", n)
        again = repeated_words(number) if len(place) < n else 0
    else:
        place, again = {}, 0
    letters = max(word_chars, 1)
    return [n, word_chars, int(of[3]), duplicates, again], [
        of[3] / letters, of[5] / letters, of[4] / letters, word_chars / max(n, 1), len(place) / max(n, 1) ** 0.9]


class Forest:
    """Random splits, all trees in flat arrays: feature, cut, left child (right is the next), path length of leaves."""

    def __init__(self, trees: list[tuple], rows: int):
        """``trees``: feature, cut, child and length of each (``grow``), grown on ``rows`` rows each."""
        self.rows, self.depth = rows, depth(rows)
        self.roots = np.cumsum([0, *(len(t[0]) for t in trees)])[:-1]
        parts = [[np.asarray(t[k], "f8" if k % 2 else "i8") for t in trees] for k in range(4)]
        parts[2] = [np.where(c < 0, -1, c + root) for c, root in zip(parts[2], self.roots)]
        self.feature, self.cut, self.child, self.length = (np.concatenate(p) if p else np.zeros(0) for p in parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, 0.5 and less for ordinary rows."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                child = self.child[node]
                node = np.where(child < 0, node, child + (x[every, self.feature[node]] >= self.cut[node]))
            total += self.length[node]
        return 2.0 ** -(total / max(len(self.roots), 1) / max(expected(self.rows), 1e-9))


def expected(n: int) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def depth(rows: int) -> int:
    """Deepest split of a tree of so many rows."""
    return max(1, int(np.ceil(np.log2(max(rows, 2)))))


def grow(x: np.ndarray, deepest: int, random: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """One tree by random splits: feature, cut, left child (-1: leaf), path length."""
    feature, cut, child, length = [0], [0.0], [-1], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, own, level = todo.pop()
        low, high = own.min(0), own.max(0)
        wide = np.flatnonzero(high > low)
        if level >= deepest or len(own) <= 1 or not len(wide):
            length[node] = level + expected(len(own))
            continue
        f = int(random.choice(wide))
        feature[node], cut[node], child[node] = f, random.uniform(low[f], high[f]), len(feature)
        go = own[:, f] >= cut[node]
        for part in (own[~go], own[go]):
            if len(part):
                todo.append((len(feature), part, level + 1))
            feature.append(0), cut.append(0.0), child.append(-1), length.append(level + 1.0)
    return feature, cut, child, length


def scale(x: np.ndarray) -> np.ndarray:
    """Rates are squeezed so that splits fall where they differ, not only in the far tail."""
    out = np.array(x, "f8").reshape(-1, len(FEATURES))
    out[:, :3] = np.sqrt(out[:, :3])
    return out


def base_failed(n: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (n < LEAST_WORDS) | (100 * again > round(100 * REPEATED) * n)


def passing(docs: DataFrame) -> DataFrame:
    """doc_id and scaled features ``x`` of the documents that pass the base rules."""
    def make() -> Callable[[list[str]], dict]:
        def compute(texts: list[str]) -> dict:
            found = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in found], "i8").reshape(-1, len(COUNTS))
            at = np.flatnonzero(~base_failed(counts[:, 0], counts[:, 4])).tolist()
            return {None: at, "x": scale(np.array([found[i][1] for i in at])).tolist()}
        return compute

    return extended(docs, ("doc_id",), "x array<double>", make)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), "f8").reshape(-1, len(FEATURES))


def fit_forest(rows: DataFrame, trees: int = TREES, size: int = ROWS, seed: int = 7) -> Forest:
    """Trees of ``size`` of all ``rows`` (doc_id, x) each, drawn without replacement and grown where Spark puts them.

    A tree's rows are those with the smallest of its own hashes of doc_id and x: the same for any partitioning. A task sends on only hashes under a bound
    that about twice as many rows stay under. Rows that repeat an id and its features count once.
    """
    known = stored(rows.select("x", F.xxhash64("doc_id", "x").alias("key")).distinct(), "quality-features")
    total = known.count()
    deepest, few = depth(min(size, total)), total <= 2 * size
    bound = np.uint64(0 if few else int(2 * size / total * (1 << 64)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            key, x = b["key"].to_numpy("i8").view("u8"), b["x"].to_numpy()
            for t in range(trees):
                h = mixed(key + np.uint64((seed * trees + t) * 0x9E3779B97F4A7C15 % (1 << 64)))
                at = np.arange(len(b)) if few else np.flatnonzero(h < bound)
                if len(at):
                    yield pd.DataFrame({"tree": t, "hash": h[at].view("i8"), "x": x[at]})

    def plant(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x, h = matrix(b["x"]), b["hash"].to_numpy("i8").view("u8")
        x = x[np.lexsort((*x.T, h))[:size]]
        return pd.DataFrame([(key[0], *grow(x, deepest, np.random.default_rng([key[0], seed])))], columns=["tree", "feature", "cut", "child", "length"])

    drawn = known.mapInPandas(draw, "tree int, hash long, x array<double>")
    planted = drawn.groupBy("tree").applyInPandas(plant, "tree int, feature array<int>, cut array<double>, child array<int>, length array<double>")
    return Forest([tuple(r)[1:] for r in sorted(planted.collect())], min(size, total))


def mixed(key: np.ndarray) -> np.ndarray:
    """An even 64-bit hash of each number (the finalizer of SplitMix64)."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def threshold(scored: DataFrame, loss: float = LOSS) -> float:
    """The score that best tells bad labelled rows (score, good) from good ones and rejects at most ``loss`` of the good.

    Equal scores are counted first and sorted by range; sums inside a range and those of the ranges above give what each score would reject.
    """
    counts = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ranged = stored(counts.repartitionByRange(partitions(scored.sparkSession), "score").withColumn("range", F.spark_partition_id()), "quality-scores")
    # one row per range, so that one window may hold them
    sums = ranged.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    every, above = Window.partitionBy(), Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("range", *(F.coalesce(F.sum(c).over(above), zero).alias(f"{c}_above") for c in "gb"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "gb"))
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("range", "score", F.sum("good").over(within).alias("good"), F.sum("bad").over(within).alias("bad")).join(sums, "range").where("g_all > 0 AND b_all > 0")
    lost, found = (F.col("good") + F.col("g_above")) / F.col("g_all"), (F.col("bad") + F.col("b_above")) / F.col("b_all")
    best = placed.where(lost <= loss).select("score", (found - lost).alias("value")).orderBy(F.desc("value"), F.desc("score")).first()
    if best is None or best["value"] <= 0:
        return 1.0
    after = ranged.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
    return (best["score"] + (best["score"] - 0.01 if after is None else after)) / 2


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """Forest and threshold from all labelled documents that pass the base rules. Only features move, no text."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = stored(passing(docs).join(labels, "doc_id").select("doc_id", "x", (F.col("quality") == 1).alias("good")), "quality-labelled")
    forest = fit_forest(rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame({"score": forest.score(matrix(b["x"])), "good": b["good"]})

    return forest, threshold(rows.select("x", "good").mapInPandas(score, "score double, good boolean"))


def judge(docs: DataFrame, forest: Forest, cut: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the five counts, base_failed, kept and the anomaly score of every document."""
    def make() -> Callable[[list[str]], dict]:
        def compute(texts: list[str]) -> dict:
            found = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in found], "i8").reshape(-1, len(COUNTS))
            failed = base_failed(counts[:, 0], counts[:, 4])
            score = forest.score(scale(np.array([f for _, f in found])))
            return {**dict(zip(COUNTS, counts.T)), "base_failed": failed, "kept": ~failed & (score < cut), "anomaly": score}
        return compute

    return extended(docs, keep, ", ".join([*(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, anomaly double"]), make)
