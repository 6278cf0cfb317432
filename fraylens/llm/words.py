"""Exact ids of a lower-casing word BPE (one that drops white space), word by word.

White space never joins two tokens in such a tokenizer. Texts are cut into words side by side, and each distinct word is resolved
once. Chunks between ASCII white space with anything but ASCII and the letters up to U+00FF are cut one by one. What the short rules
below don't cover (special strings, letters beyond U+017F, control characters) goes through the library, so ids always equal those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from fraylens.llm.shared import worker_cache

ID = np.dtype("<u4")
ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}\x85\xa0]+")
CONTROL = re.compile(rb"[\x00-\x1f\x7f]")

#: Texts are cut side by side as soon as they have this many bytes together; a text isn't divided.
SIDE_BY_SIDE = 4_000_000
#: What a lower-cased byte is. ``ODD``: control characters and all beyond ASCII.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
KINDS = bytes(BLANK if chr(b) in " \t\n\r\x0b\x0c" else ODD if b < 32 or b > 126 else LETTER if 97 <= b <= 122 else DIGIT if 48 <= b <= 57 else SIGN for b in range(256))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut(raws: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in their order, which of them are odd chunks as a whole, and up to which word each text reaches."""
    joined = (b"\n".join(raws) + b"\n\n").lower()
    text, kind = (np.frombuffer(bytearray(x), "u1") for x in (joined, joined.translate(KINDS)))
    odd = np.flatnonzero(kind == ODD)
    lead = odd[text[odd] == 0xC3]
    lead = lead[(text[lead + 1] != 0x97) & (text[lead + 1] != 0xB7)]  # U+00C0 to U+00FF without the two signs
    kind[lead] = kind[lead + 1] = LETTER
    odd = odd[kind[odd] == ODD]
    if odd.size:
        blank = np.flatnonzero(kind == BLANK)
        k = np.unique(np.searchsorted(blank, odd))
        edge = np.zeros(len(kind), "i1")
        edge[np.where(k > 0, blank[k - 1] + 1, 0)] = 1
        edge[blank[k]] = -1
        kind[np.cumsum(edge, dtype="i1").view("?")] = ODD
    capital = lead[(text[lead + 1] < 0x9F) & (kind[lead] == LETTER)] + 1
    text[capital] += 0x20

    new = np.empty(len(kind), "?")
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == DIGIT
    tick = np.flatnonzero(text == ord("'"))
    tick = tick[(kind[tick] == SIGN) & new[tick]]  # it begins a run of signs: 's 't 'm 'd 're 've 'll are words
    one, two = text[tick + 1], text[tick + 2]
    short = tick[np.isin(one, list(b"stmd"))]
    long = tick[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    new[short + 1] = new[long + 1] = False
    new[short + 2] = new[long + 3] = True

    black = kind != BLANK
    starts = np.flatnonzero(new & black)
    letters = text[black]
    offsets = np.append(np.flatnonzero(new[black]), len(letters)).astype("i4")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, kind[starts] == ODD, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian 32-bit bytes.

    Memory is bounded by ``limit`` remembered words and as many odd chunks; beyond it, those of the latest texts stay.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer, self.limit = load(path), limit
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items() if b != 32})
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.special = any(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        raws: list[bytes] = []
        whole, size = {}, 0
        for i, text in enumerate(texts):
            raw = text.encode()
            if self.special and b"<|" in raw:
                whole[i], raw = self._whole(text), b""
            raws.append(raw)
            size += len(raw)
            if size >= SIDE_BY_SIDE:
                out += self._together(raws)
                raws, size = [], 0
        if raws:
            out += self._together(raws)
        for i, ids in whole.items():
            out[i] = ids
        return out

    def _together(self, raws: list[bytes]) -> list[bytes]:
        words, odd, ends = cut(raws)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        chunks = {distinct[k]: k for k in np.unique(codes[odd]).tolist()}
        found = list(map(self.words.get, distinct))
        fresh = {w: k for k, w in enumerate(distinct) if found[k] is None and w not in chunks}
        self._learn(fresh, chunks)
        for w, k in fresh.items():
            found[k] = self.words[w]
        for chunk, k in chunks.items():
            found[k] = self.chunks[chunk]
        if len(self.chunks) > self.limit or len(self.words) > self.limit:
            latest = dict(zip(distinct, found))
            self.chunks = {c: latest.pop(c) for c in chunks}
            self.words = latest
        ids = np.frombuffer(b"".join(found), ID)
        n = np.fromiter(map(len, found), "i8", len(found)) // 4
        first, n = (np.cumsum(n) - n)[codes], n[codes]
        stop = np.cumsum(n)
        at = np.repeat(first - (stop - n), n) + np.arange(n.sum())
        data, bounds = ids[at].tobytes(), (4 * np.append(0, stop)[ends]).tolist()
        return [data[a:b] for a, b in zip([0, *bounds], bounds)]

    def merge(self, word: bytes) -> bytes:
        """Exact merges of one word."""
        return self.merge_all([word])[0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merges of words (they hold no blank)."""
        tokens, ids, ends = self.tokenizer.model.tokenize, [], []
        for word in b" ".join(words).decode("latin-1").translate(self.letters).split(" "):
            ids += [t.id for t in tokens(word)]
            ends.append(4 * len(ids))
        data = np.array(ids, ID).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def resolve(self, words: list[bytes]) -> list[bytes]:
        return self.merge_all(words) if words else []

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    @staticmethod
    def pieces(chunk: bytes) -> list[bytes] | None:
        """The words of a chunk; None if the library must decide."""
        if chunk.isascii():
            return ASCII.findall(chunk) if chunk.isalpha() or not CONTROL.search(chunk) else None
        text = chunk.decode()
        if max(text) >= "ƀ" or CONTROL.search(chunk):
            return None
        return [w.encode() for w in LATIN.findall(text.lower())]

    def _learn(self, words: Iterable[bytes], chunks: Iterable[bytes]) -> None:
        fresh = {c: self.pieces(c) for c in chunks if c not in self.chunks}
        words = list({w for p in (words, *filter(None, fresh.values())) for w in p if w not in self.words})
        self.words.update(zip(words, self.resolve(words)))
        get = self.words.__getitem__
        for chunk, found in fresh.items():
            self.chunks[chunk] = self._whole(chunk.decode()) if found is None else b"".join(map(get, found))


@worker_cache
def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary."""
    return WordEncoder(path)
