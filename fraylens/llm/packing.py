"""Best-fit packing of token pieces into fixed-length sequences, improved by swap-based local search.

Pieces meet in blocks of a fixed mean size (dealt by a hash of their key, so no key, source or length decides a block's size). In a
block, pieces go longest first into the fullest sequence that still takes them; then documents are exchanged one for one, two for one or
moved between underfull sequences as long as the sum of squared fills grows, which drains the emptiest ones until they vanish.
Sequences that stay underfull are taken apart and packed again in fewer blocks, so what blocks waste doesn't add up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.llm.shared import extended, stored
from fraylens.llm.words import encoder

CAPACITY = 2048
#: Mean pieces of a block, rounds of packing, and the fill (of capacity) under which a later round packs a sequence anew.
BLOCK, ROUNDS, UNDERFULL = 2000, 3, 0.99
#: Passes of the local search over the underfull sequences of a block, if it still improves.
PASSES = 8


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of text + ``end_id``. Null texts are empty ones (a single ``end_id``)."""
    end = np.array([end_id], "<u4").tobytes()
    def make() -> Callable[[list[str]], dict]:
        def cut(texts: list[str]) -> dict:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(tokenizer_path).encode(texts)):
                ids += end
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first:first + 4 * capacity]
                    at.append(i), piece.append(k), start.append(first // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            return {None: at, "piece": piece, "start": start, "length": length, "ids_crc32": crc}
        return cut

    return extended(docs, keep, "piece int, start long, length long, ids_crc32 long", make, "fraylens.llm.words.encoder")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            free, k = capacity - lengths[i], len(bins) - 1
        else:
            free, k = room.pop(at)
            bins[k].append(i)
            free -= lengths[i]
        if free:
            insort(room, (free, k))
    return bins


def _exchange(a: list[int], b: list[int], lengths: list[int], free: int, lead: int) -> tuple[list[int], list[int]] | None:
    """The best move of ``b``'s documents into ``a``: what leaves b, what leaves a. ``lead``: fill of a less that of b.

    A gain of d tokens for ``a`` changes the sum of squares by 2 d (lead + d): it must be positive.
    """
    best, found = max(0, -lead), None
    gone = [([], 0), *(([y], lengths[y]) for y in a)]
    for i, x in enumerate(b):
        for out, less in gone:
            d = lengths[x] - less
            if best < d <= free:
                best, found = d, ([x], out)
        for z in b[i + 1:]:
            two = lengths[x] + lengths[z]
            for out, less in gone[1:]:
                if best < two - less <= free:
                    best, found = two - less, ([x, z], out)
        if best == free:
            break
    return found


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills; empty bins go."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(passes):
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k))
        changed = False
        for donor in under:
            for taker in reversed(under):
                if not bins[donor]:
                    break
                if taker == donor or fill[taker] == capacity or not bins[taker]:
                    continue
                if move := _exchange(bins[taker], bins[donor], lengths, capacity - fill[taker], fill[taker] - fill[donor]):
                    give, back = move
                    bins[taker] = [i for i in bins[taker] if i not in back] + give
                    bins[donor] = [i for i in bins[donor] if i not in give] + back
                    d = sum(lengths[i] for i in give) - sum(lengths[i] for i in back)
                    fill[taker] += d
                    fill[donor] -= d
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and any more) plus sequence_id and offset, each piece once.

    Repeated rows are packed as often as they come; an empty table gives no row.
    """
    columns = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, __fill long"
    done, left = [], pieces
    for turn in range(rounds):
        total = left.count()
        blocks = max(1, -(-total // block))
        last = turn == rounds - 1 or blocks == 1
        base = (turn << 56)

        def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
            lengths = rows["length"].tolist()
            at, sequence, offset, fill = [], [], [], []
            for k, members in enumerate(pack_block(lengths, capacity)):
                place = 0
                for i in members:
                    at.append(i), sequence.append(base + (int(key[0]) << 24) + k), offset.append(place)
                    place += lengths[i]
                fill += [place] * len(members)
            return rows[columns].iloc[at].assign(sequence_id=sequence, offset=offset, __fill=fill)

        keyed = left.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(blocks)))
        packed = stored(keyed.groupBy("__block").applyInPandas(solve, schema), f"packed-{turn}")
        if last:
            done.append(packed)
            break
        done.append(packed.where(F.col("__fill") >= int(UNDERFULL * capacity)))
        left = packed.where(F.col("__fill") < int(UNDERFULL * capacity)).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__fill")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokenizes, cuts and packs whole documents."""
    return pack(stored(tokenize(docs, tokenizer_path, capacity, keep=keep), "pieces"), capacity)
