"""SimHash near copies by multi-index hashing.

A fingerprint of 64 bits is cut into two segments, each with a table of all values. The members of the Hamming ball of radius 1 around a fingerprint's
own segment are enumerated and looked up in that segment's table; what they meet is verified on all 64 bits (``near_fingerprints``). A value that many
fingerprints share is split by the other bits: its fingerprints meet at addresses that keep all bits but one, in a table sorted by range, where
matches are neighbours and no group is ever paired with itself (``match``).

``link`` gives the components of fingerprints with 2 or fewer differing bits, exact and complete. Equal fingerprints are one table entry.
Near copies by similarity of five-word shingles, which uses these matches, are in ``near_dedup``.

Null texts are empty ones, and empty ones are copies of each other. Repeated rows belong to one group. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.shared import discard, extended, stored

SHINGLE, RADIUS, SEED = 3, 2, 42


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, blank-joined; of the whole sequence if it is shorter; nothing without words."""
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    start = np.zeros(len(words) + 1, "i8")
    np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1, out=start[1:])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(start[:-size].tolist(), (start[size:] - 1).tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 100_000):  # long texts in bounded memory
        ones += np.unpackbits(hashes[at:at + 100_000].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text.encode().lower().split(), size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row."""
    return extended(docs, ("doc_id",), "fp long", lambda: lambda texts: {"fp": [signed(fingerprint(t, size)) for t in texts]})


def ball(value: Column, first: int, bits: int) -> list[Column]:
    """``value`` and what differs from it in one of ``bits`` bits from ``first`` on."""
    return [value, *(value.bitwiseXOR(F.lit(signed(1 << b))) for b in range(first, first + bits))]


def match(keys: DataFrame, most: int, name: str) -> DataFrame:
    """Pairs (a < b) of ids that share an address and whose sketches differ in at most ``most`` bits.

    ``keys`` has address, id, sketch. Each entry is compared with the first of its run, which is enough where all entries of a run are alike.
    Runs that go on in the next task are joined through one border row per task.
    """
    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        first = begin = last = None  # first row of the current run, of the task, last row seen

        def pairs(run_head: np.ndarray, rows: np.ndarray, known: np.ndarray) -> pd.DataFrame:
            a, b = run_head[known], rows[known]
            near = np.bitwise_count((a[:, 2] ^ b[:, 2]).view("u8")) <= most
            a, b = a[near, 1], b[near, 1]
            other = a != b
            return pd.DataFrame({"a": np.minimum(a, b)[other], "b": np.maximum(a, b)[other]}).drop_duplicates()

        for batch in batches:
            rows = batch[["address", "id", "sketch"]].to_numpy("i8")
            if not len(rows):
                continue
            begin = rows[0] if begin is None else begin
            new = np.empty(len(rows), bool)
            new[0] = first is None or first[0] != rows[0, 0]
            new[1:] = rows[1:, 0] != rows[:-1, 0]
            head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
            heads = rows[np.maximum(head, 0)]
            if not new[0]:
                heads[head < 0] = first
            yield pairs(heads, rows, ~new)
            first, last = heads[-1].copy(), rows[-1].copy()
        if begin is not None:
            yield pd.DataFrame({"task": [task], "begin": [begin.tolist()], "head": [first.tolist()], "last": [last.tolist()]})

    schema = "a long, b long, task int, begin array<long>, head array<long>, last array<long>"

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in neighbours(batches):
            yield found.reindex(columns=["a", "b", "task", "begin", "head", "last"]).astype(object).where(lambda d: d.notna(), None)

    # borders are at most one row per task, so that one window may hold them
    spread = keys.repartitionByRange("address", "id").sortWithinPartitions("address", "id")
    found = stored(spread.mapInPandas(complete, schema), name)
    order = Window.orderBy("task")
    near = lambda x, y: F.bit_count(x[2].bitwiseXOR(y[2])) <= most
    borders = found.where(F.col("task").isNotNull()).select(
        "begin", *(F.lag(c).over(order).alias(f"past_{c}") for c in ("head", "last"))).where(F.col("begin")[0] == F.col("past_last")[0])
    over = None
    for c in ("head", "last"):
        one = borders.where(near(F.col("begin"), F.col(f"past_{c}")) & (F.col("begin")[1] != F.col(f"past_{c}")[1])).select(
            F.least(F.col("begin")[1], F.col(f"past_{c}")[1]).alias("a"), F.greatest(F.col("begin")[1], F.col(f"past_{c}")[1]).alias("b"))
        over = one if over is None else over.unionByName(one)
    return found.where(F.col("task").isNull()).select("a", "b").unionByName(over).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label: the smallest node reachable over ``edges`` (a, b). Labels spread to neighbours and jump to their label's label.

    The joins have one row per node on one side; a label that many nodes share is split by the adaptive skew join. A round's tables are
    deleted as soon as the next ones are written.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = stored(labels.join(to, "label").select("node", "label", F.least("label", "further").alias("next")), f"{name}-jump")
        near = both.join(jumped.select(F.col("node").alias("b"), "next"), "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("near"))
        after = stored(jumped.join(near, "node").select("node", F.col("label").alias("old"), F.least("next", "near").alias("label")), f"{name}-labels")
        discard(labels, jumped)
        labels = after
        if after.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return after.select("node", "label")


HALF = 32
#: Fingerprints that share a segment's value beyond this number are matched at addresses of 63 bits instead.
CROWDED = 64


def segments(value: Column) -> list[Column]:
    """The two segments of a fingerprint."""
    return [F.shiftrightunsigned(value, HALF), value.bitwiseAND(F.lit((1 << HALF) - 1))]


def near_fingerprints(known: DataFrame, name: str = "simhash") -> DataFrame:
    """a, b: ids of all pairs of ``known`` (distinct fp, id) whose fingerprints differ in at most two bits.

    Of two differing bits, one segment holds one at most. So every fingerprint probes the table of each segment with the Hamming ball of radius 1 around
    its own value there, and the entries it meets are verified on all 64 bits. Values of a segment with more than ``CROWDED`` entries are split by the
    rest of the fingerprint: whoever has or probes one is entered at the 65 addresses of ``ball`` over all bits, where only near fingerprints meet.
    """
    table = known.select("id", "fp", F.posexplode(F.array(*segments(F.col("fp")))).alias("segment", "value"))
    crowded = stored(table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).drop("n"), f"{name}-crowded")
    balls = F.array(*(F.array(*ball(s, 0, HALF)) for s in segments(F.col("fp"))))
    probes = known.select("id", "fp", F.posexplode(balls).alias("segment", "values")).select("id", "fp", "segment", F.explode("values").alias("value"))
    split = not crowded.isEmpty()
    x, y = probes.alias("x"), (table.join(crowded, ["segment", "value"], "left_anti") if split else table).alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    met = x.join(y, (F.col("x.segment") == F.col("y.segment")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") != F.col("y.id")) & close).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    if not split:
        return met.distinct()
    hot = stored(probes.join(crowded, ["segment", "value"], "left_semi").select("id", "fp").distinct(), f"{name}-hot")
    keys = hot.select(F.explode(F.array(*ball(F.col("fp"), 0, 64))).alias("address"), "id", F.col("fp").alias("sketch"))
    return met.unionByName(match(keys, RADIUS, f"{name}-matches")).distinct()


def link(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most two differing bits.

    Equal fingerprints meet in one row first, so groups of copies of any size cost one table entry.
    """
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-groups")
    known = groups.where(F.col("first_id").isNotNull()).select("fp", F.col("first_id").alias("id"))
    edges = near_fingerprints(known)
    label = components(edges, "simhash")
    reached = groups.join(label, groups["first_id"] == label["node"], "left").select("fp", F.coalesce("label", "first_id").alias("component_id"))
    return prints.join(stored(reached, "simhash-components"), "fp").select("doc_id", "fp", "component_id")
