"""Spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced code point have letter-count vectors at a squared distance of at most two. Words lie in
blocks of equal length and equal counts of ``CLASSES`` letter classes; an edit leads to the same block, to one where a letter has changed its class,
or to one of the next length. Each block is multiplied with its own words and with the words of the adjacent blocks (one NumPy product per pair of
tiles), products give squared distances, and pairs at most two apart are verified letter by letter. Every pair of words meets in one block at most.

Skew: a block of more than ``TILE`` words is cut into tiles by hash; a task holds one tile and streams what is compared with it. Comparisons grow with
the square of a block, i.e. with the number of distinct words, not with the text.

Null texts have no words, a null id counts as an empty one, repeated rows count as often as they occur, very long runs are ordinary words.
Ties between near words of equal count go to the first in code-point order. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.llm.shared import partitions, stored

RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")
LOWER = {c: c + 32 for c in range(65, 91)}
SHORTEST, LEAST, TIMES, DROP = 7, 2, 10, 31
#: Letters by frequency are dealt to the classes in turn; what is no letter from a to z shares six more columns of the count vectors.
CLASSES, LETTERS, OTHERS, TILE = 5, "etaoinshrdlcumwfgypbvkjxqz", 6, 2000
WORDS_HELD, WIDTH = 300_000, 4096


def occurrences(doc_id: object, text: str) -> Counter:
    """The text's words with their counts: maximal runs, lower-cased, of which every 31st (by crc32) loses a code point."""
    start, out = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode()), Counter()
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= SHORTEST:
            out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: words with two occurrences or more in all texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, n in occurrences(doc_id, text).items():
                    held[word] += n
                if len(held) > WORDS_HELD:
                    yield pd.DataFrame({"word": pd.Series(list(held.keys()), dtype=object), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": pd.Series(list(held.keys()), dtype=object), "n": pd.Series(list(held.values()), dtype="i8")})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points one after the other, where each word starts, and the words' lengths."""
    size = np.fromiter(map(len, words), "i8", len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.cumsum(size) - size, size


def vectors(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letter counts of each word; 26 letters and ``OTHERS`` columns that all other code points share."""
    letter = points.astype("i8") - 97
    letter = np.where((letter >= 0) & (letter < 26), letter, 26 + points % OTHERS)
    width = 26 + OTHERS
    return np.bincount(np.repeat(np.arange(len(size)), size) * width + letter, minlength=len(size) * width).reshape(-1, width)


CLASS = np.array([LETTERS.index(chr(97 + i)) % CLASSES for i in range(26)] + [i % CLASSES for i in range(OTHERS)])


def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word at its own block (guest false) and at those adjacent blocks that it is compared in (guest true)."""
    digit = np.int64(1) << (12 * np.arange(CLASSES, dtype="i8"))
    for batch in batches:
        words = batch["word"].tolist()
        if not words:
            continue
        points, _, size = code_points(words)
        letters = vectors(points, size)
        counts = np.stack([letters[:, CLASS == k].sum(1) for k in range(CLASSES)], 1).astype("i8") % WIDTH
        own = counts @ digit
        found = [(np.arange(len(words)), size, own, False)]
        for i in range(CLASSES):
            more = own - counts[:, i] * digit[i] + (counts[:, i] + 1) % WIDTH * digit[i]
            found.append((np.arange(len(words)), size + 1, more, True))
            for j in range(CLASSES):
                moved = more - counts[:, j] * digit[j] + (counts[:, j] - 1) % WIDTH * digit[j]
                rows = np.flatnonzero((counts[:, j] > 0) & (moved > own)) if i != j else []
                found.append((rows, size[rows], moved[rows], True) if len(rows) else (np.zeros(0, int),) * 3 + (True,))
        rows = np.concatenate([f[0] for f in found])
        yield pd.DataFrame({"size": np.concatenate([f[1] for f in found]).astype("i4"), "block": np.concatenate([f[2] for f in found]),
                            "guest": np.concatenate([np.full(len(f[0]), f[3]) for f in found]),
                            "word": pd.Series(np.array(words, object)[rows], dtype=object), "n": batch["n"].to_numpy()[rows]})


def one_edit(points: np.ndarray, a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one edit. a, b: where the words start; of_a, of_b: their lengths, of_a at most of_b and at least of_b - 1."""
    out = np.zeros(len(a), bool)
    step = max(1, 2_000_000 // int(of_b.max(initial=1)))
    last = len(points) - 1
    for at in range(0, len(a), step):
        s = slice(at, at + step)
        size = of_a[s, None]
        where = np.arange(int(of_a[s].max(initial=0)))[None, :]
        inside = where < size
        left = points[np.minimum(a[s, None] + where, last)]
        straight = (left == points[np.minimum(b[s, None] + where, last)]) | ~inside
        shifted = (left == points[np.minimum(b[s, None] + where + 1, last)]) | ~inside
        differing = (~straight).sum(1)
        prefix = np.where(straight.all(1), of_a[s], np.argmin(straight, 1))
        suffix = np.where(shifted.all(1), of_a[s], of_a[s] - (shifted.shape[1] - np.argmin(shifted[:, ::-1], 1)))
        out[s] = np.where(of_a[s] == of_b[s], differing == 1, prefix + suffix >= of_a[s])
    return out


class Tile:
    """Words of one tile as they come: what follows is compared with those that are here already."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.n: list[np.ndarray] = []

    def near(self, words: list[str], n: np.ndarray, join: bool) -> Iterator[pd.DataFrame]:
        """Pairs of ``words`` with the tile's words and, if they ``join`` it, with each other."""
        for at in range(0, len(words), TILE):
            new, count = words[at:at + TILE], n[at:at + TILE]
            if join:
                here = len(self.words)
                self.words += new
                self.n.append(count)
            every, counts = self.words, np.concatenate(self.n) if self.n else np.zeros(0, "i8")
            if not every:
                continue
            points, start, size = code_points(every + new)
            both = vectors(points, size).astype("f4" if size.max() < 1000 else "f8")
            k = len(every)
            for first in range(0, k, TILE):
                left = both[first:min(first + TILE, k)]
                square = (left * left).sum(1)[:, None] + (both[k:] * both[k:]).sum(1)[None, :] - 2 * left @ both[k:].T
                x, y = np.nonzero(square <= 2)
                x += first
                if join:
                    keep = x < here + y  # each pair of the tile once
                    x, y = x[keep], y[keep]
                z = y + k
                short, long = np.where(size[x] <= size[z], x, z), np.where(size[x] <= size[z], z, x)
                close = size[long] - size[short] <= 1
                x, y, short, long = x[close], y[close], short[close], long[close]
                good = one_edit(points, start[short], size[short], start[long], size[long])
                x, y = x[good], y[good]
                if len(x):
                    a, b = np.array(every, object)[x], np.array(new, object)[y]
                    yield pd.DataFrame({"word": pd.Series(np.concatenate([a, b]), dtype=object), "other": pd.Series(np.concatenate([b, a]), dtype=object),
                                        "other_n": np.concatenate([count[y], counts[x]])})


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by tile, a tile's own words first: near pairs, both ways round."""
    key, tile = None, Tile()
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["size", "block", "tile", "guest"]].astype("i8").to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        words, n = batch["word"].tolist(), batch["n"].to_numpy("i8")
        for a, b in zip(cuts, cuts[1:]):
            if key != (now := tuple(keys[a, :3])):
                key, tile = now, Tile()
            yield from tile.near(words[a:b], n[a:b], join=not keys[a, 3])


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: all pairs of ``words`` (word, n) that differ by exactly one edit, both ways round."""
    at = words.mapInPandas(places, "size int, block long, guest boolean, word string, n long")
    homes = words.mapInPandas(places, "size int, block long, guest boolean, word string, n long").where("not guest")
    crowded = homes.groupBy("size", "block").agg(F.count("*").alias("__words")).where(F.col("__words") > TILE).select(
        "size", "block", F.ceil(F.col("__words") / TILE).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("word"), tiles).cast("int")
    every = F.sequence(F.lit(0), tiles - 1)
    # a tile's words are also compared with those of the tiles before it
    dealt = F.when(F.col("guest"), F.transform(every, lambda t: F.struct(t.alias("tile"), F.lit(True).alias("guest")))).otherwise(
        F.transform(F.sequence(F.lit(0), own), lambda t: F.struct(t.alias("tile"), (t != own).alias("guest"))))
    spread = at.join(crowded, ["size", "block"], "left").select("size", "block", "word", "n", F.explode(dealt).alias("d")).select(
        "size", "block", F.col("d.tile").alias("tile"), F.col("d.guest").alias("guest"), "word", "n")
    sorted_ = spread.repartition(partitions(words.sparkSession), "size", "block", "tile").sortWithinPartitions("size", "block", "tile", "guest")
    return sorted_.mapInPandas(compare, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word along its forms to the last. Counts grow tenfold with every step, so a few doublings reach it."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = stored(paths.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if paths.where("moved").isEmpty():
            return paths.select("word", "root")
        paths = paths.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    words = stored(count_words(docs), "spelling-words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    much = -F.col("best.less") >= TIMES * F.col("n")
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return found.join(roots(found.where(F.col("form").isNotNull())), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
