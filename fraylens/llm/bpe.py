"""Encoding and decoding with a minimal acyclic transducer over the corpus' frequent words.

Words are counted over all documents. The ``entries`` most frequent ones (bounded, so the lexicon stays small at any input size) are
compiled into an automaton that shares prefixes and suffixes; outputs on its arcs add up to a word's number, which points to its ids.
The arrays are one file in the shared folder, memory-mapped by every worker. Batches of distinct words walk the automaton side by side;
words it doesn't hold are merged exactly. Null texts count as empty ones; repeated rows come out as often as they come in.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens import session
from fraylens.llm.shared import extended, shared_path, stored, text_of, worker_cache
from fraylens.llm.words import ID, WordEncoder

#: Words in the lexicon at most, and how often one must occur. Rarer words are merged, not lost.
ENTRIES, LEAST = 30_000, 5
#: Longer words are left to the merges.
LONGEST = 40


class Lexicon:
    """A minimal acyclic transducer in four arrays.

    ``step[s, byte class]`` is the next state (0: none), ``add`` the output of that arc, ``final`` marks states where words end.
    The sum of outputs is the word's rank in sorted order; ``ids[first[rank]:first[rank + 1]]`` are its ids.
    """

    NAMES = ("classes", "step", "add", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, bytes]) -> Lexicon:
        """From word -> ids (bytes). Suffixes of equal shape become one state as soon as a sorted word leaves them behind."""
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        arcs: list[tuple[bool, tuple[tuple[int, int], ...]]] = [(False, ())]  # state 0: nowhere
        path: list[list] = [[False, {}]]  # open states: final, byte -> state

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out, *_ = path.pop()
                shape = (final, tuple(sorted(out.items())))
                if shape not in register:
                    register[shape] = len(arcs)
                    arcs.append(shape)
                path[-1][1][path[-1][2]] = register[shape]

        before = b""
        for word in order:
            same = len(os.path.commonprefix([before, word]))
            close(same)
            for byte in word[same:]:
                path[-1][2:] = [byte]
                path.append([False, {}])
            path[-1][0] = True
            before = word
        close(0)
        root = (path[0][0], tuple(sorted(path[0][1].items())))
        arcs.append(root)

        used = sorted({b for _, out in arcs for b, _ in out})
        classes = np.zeros(256, "u1")
        classes[used] = np.arange(1, len(used) + 1)
        step = np.zeros((len(arcs), len(used) + 1), "i4")
        add = np.zeros_like(step)
        final = np.array([f for f, _ in arcs], "?")
        below = np.zeros(len(arcs), "i4")  # words that end in or after a state; targets have smaller numbers
        for s, (ends, out) in enumerate(arcs):
            n = int(ends)
            for byte, to in out:
                step[s, classes[byte]], add[s, classes[byte]] = to, n
                n += below[to]
            below[s] = n
        parts = [np.frombuffer(words[w], ID) for w in order]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype="i8")]).astype("i8")
        return cls(dict(classes=classes, step=step, add=add, final=final, first=first, ids=np.concatenate(parts) if parts else np.zeros(0, ID)))

    def save(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)
        for name in self.NAMES:
            at = f"{path}/{name}.{uuid.uuid4().hex}"
            with open(at, "wb") as f:
                np.save(f, getattr(self, name))
            os.replace(at, f"{path}/{name}.npy")

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls({n: np.load(f"{path}/{n}.npy", mmap_mode="r") for n in cls.NAMES})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon hasn't it. All words step together, one byte at a time."""
        n = np.array([len(w) for w in words])
        state = np.full(len(words), len(self.final) - 1, "i8")
        rank = np.zeros(len(words), "i8")
        state[(n == 0) | (n > LONGEST)] = 0
        width = int(min(n.max(initial=0), LONGEST))
        letters = np.array(words, f"S{max(width, 1)}").view("u1").reshape(len(words), -1)
        for i in range(width):
            go = np.flatnonzero((n > i) & (state > 0))
            byte = self.classes[letters[go, i]]
            rank[go] += self.add[state[go], byte]
            state[go] = self.step[state[go], byte]
        rank[(state == 0) | ~self.final[state]] = -1
        return rank


class LexiconEncoder(WordEncoder):
    """Frequent words by the transducer, all others by exact merges."""

    def __init__(self, path: str, lexicon: str):
        super().__init__(path)
        self.lexicon = Lexicon.open(lexicon)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.plain = self.tokenizer.decoder is None

    def resolve(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        first, ids = self.lexicon.first, self.lexicon.ids
        return [self.merge(w) if r < 0 else ids[first[r]:first[r + 1]].tobytes() for w, r in zip(words, self.lexicon.ranks(words).tolist())]

    def decode(self, ids: bytes) -> bytes:
        """As the library's ``decode(ids, skip_special_tokens=False)``: without a decoder, tokens joined by blanks."""
        numbers = np.frombuffer(ids, ID).tolist()
        if not self.plain:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.strings.__getitem__, numbers))


@worker_cache
def lexicon_encoder(path: str, lexicon: str) -> LexiconEncoder:
    return LexiconEncoder(path, lexicon)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents: chunks are counted per task, and their words in Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def words() -> pd.DataFrame:
            found: Counter[bytes] = Counter()
            for chunk, n in total.items():
                for w in WordEncoder.pieces(chunk) or ():
                    found[w] += n
            return pd.DataFrame({"word": list(found), "n": list(found.values())})

        for b in batches:
            for text in b["text"]:
                total.update(text.encode().lower().split())
            if len(total) > 400_000:
                yield words()
                total = Counter()
        yield words()

    parts = docs.select(text_of().alias("text")).mapInPandas(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, entries: int) -> DataFrame:
    """The ``entries`` words with the largest counts (ties: first in byte order).

    A histogram of counts (four bars per power of two, some hundred rows) gives a bound that little more than ``entries`` words reach, so what tasks
    send to the driver doesn't grow with their number.
    """
    counts = stored(counts, "word-counts")
    bar = F.floor(F.log2("n") * 4)
    least, seen = 0, 0
    for least, words in sorted(counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("words")).collect(), reverse=True):
        seen += words
        if seen >= entries:
            break
    return counts.where(bar >= least).orderBy(F.desc("n"), "word").limit(entries)


def build_lexicon(docs: DataFrame, tokenizer_path: str, entries: int = ENTRIES, least: int = LEAST) -> str:
    """Compiles the most frequent words into a new folder of the shared directory; returns its path."""
    top = most_frequent(word_counts(docs).where((F.col("n") >= least) & (F.length("word") <= LONGEST)), entries)
    encoder = WordEncoder(tokenizer_path)
    words = [bytes(r["word"]) for r in top.collect()]
    path = shared_path(session.work_folder(docs.sparkSession, "lexicon"))
    Lexicon.compile({w: encoder.merge(w) for w in words}).save(path)
    return path


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids (array) and decoded text of every document."""
    def make() -> Callable[[list[str]], dict]:
        coder = lexicon_encoder(tokenizer_path, lexicon)

        def run(texts: list[str]) -> dict:
            ids = coder.encode(texts)
            return {"ids": [np.frombuffer(i, "<i4") for i in ids], "decoded": [coder.decode(i).decode() for i in ids]}
        return run

    return extended(docs, keep, "ids array<int>, decoded string", make, "fraylens.llm.bpe.lexicon_encoder")


def digests(docs: DataFrame, tokenizer_path: str, lexicon: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids (little-endian 32 bit) and of the decoded text; ids and texts stay in the workers."""
    def make() -> Callable[[list[str]], dict]:
        coder = lexicon_encoder(tokenizer_path, lexicon)

        def run(texts: list[str]) -> dict:
            ids = coder.encode(texts)
            return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids]}
        return run

    return extended(docs, ("doc_id",), "n_tokens long, ids_sha256 string, decoded_sha256 string", make, "fraylens.llm.bpe.lexicon_encoder")
