"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates of a label are sorted along a Hilbert curve through the ``AXES`` dimensions of largest spread and cut into blocks of ``ROWS`` rows, written as
Parquet: one record holds a block's vectors, ids and, per dimension, the least and the greatest component. ``PART`` blocks in a row are a part with the same
two bounds. From an anchor's vector q and the bounds, interval arithmetic gives the least and the greatest inner product that a block can hold,
``sum(min(q * low, q * high))`` and ``sum(max(q * low, q * high))``; a block is read for an anchor only if these can fall into one of its windows.

``search`` finds each anchor's best rows per window (closed score interval) in two passes: the most promising part of each anchor gives a first k-th best
score, which raises the window's lower end; then every part that can still hold something is read, block by block. The same search serves positives
(one open window, same label) and negatives (a window for each positive, other labels). All arithmetic is on integers, exactly.

Spread: anchors are dealt to chunks of about ``CHUNK``; a task holds the blocks of one part, or the bounds of all parts (a record per ``ROWS * PART``
candidates), and streams a chunk's anchors through. No label, however frequent, is in one task, and nothing goes through the driver but a spread per dimension.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. Of rows with the same id the first by label and vector counts,
so repeated rows count once. Missing components at the end of a shorter vector count as zero. Scores and squares must fit 64 bits. Equal scores are ordered by id.
An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.llm.shared import partitions, stored

ROWS, PART, CHUNK = 1024, 32, 5000
AXES, BITS = 8, 4
POSITIVES, NEGATIVES, EVERY = 5, 3, 50
LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: What a task holds (blocks, or bounds of parts) and what it streams (anchors) come as rows of this form.
RECORD = "key long, flow boolean, id long, label long, vectors binary, ids binary, low binary, high binary"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of small non-negative integers (Skilling's transform, vectorised)."""
    x = points.astype("i8").copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(x.shape[1]):
            turned = (x[:, i] & q) > 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(turned, p, swap)
            x[:, i] ^= np.where(turned, 0, swap)
        q >>= 1
    for i in range(1, x.shape[1]):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), "i8"), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, -1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    place = np.zeros(len(x), "i8")
    for b in range(bits - 1, -1, -1):
        for i in range(x.shape[1]):
            place = place << 1 | x[:, i] >> b & 1
    return place


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, q (integer components) of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    one = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), q.alias("q")).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


def cut_blocks(rows: DataFrame) -> DataFrame:
    """block, part, label, rows and the block's vectors, ids and bounds."""
    spark = rows.sparkSession
    axes = rows.select(F.posexplode("q").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("spread"), F.min("x").alias("low"), F.max("x").alias("high"))
    spread = sorted(axes.collect(), key=lambda r: (-r["spread"], r["axis"]))  # one row per dimension
    dims = max((r["axis"] + 1 for r in spread), default=1)
    chosen = [(r["axis"], r["low"], max(1, r["high"] - r["low"])) for r in spread[:AXES]] or [(0, 0, 1)]

    def padded(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), dims), "i8")
        for i, q in enumerate(column):
            out[i, :len(q)] = q
        return out

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = padded(batch["q"])
            cell = np.stack([((q[:, a].astype("f8") - low) * ((1 << BITS) - 1) // width) for a, low, width in chosen], 1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "place": hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS), "vector": [v.tobytes() for v in q]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count, part, held = TaskContext.get().partitionId(), 0, 0, []
        of_part, label = 0, None

        def block(rows_: list[tuple]) -> pd.DataFrame:
            rows_.sort()  # ids ascending: equal scores keep that order
            q = np.stack([np.frombuffer(v, "i8") for _, v in rows_])
            return pd.DataFrame({"block": [(task << 32) + count], "part": [(task << 32) + part], "label": [label], "rows": [len(q)], "vectors": [q.tobytes()],
                                 "ids": [np.array([i for i, _ in rows_], "i8").tobytes()], "low": [q.min(0).tobytes()], "high": [q.max(0).tobytes()]})

        for batch in batches:
            for i, l, v in zip(batch["vec_id"], batch["label"], batch["vector"]):
                if held and (l != label or len(held) == ROWS):
                    yield block(held)
                    held, count, of_part = [], count + 1, of_part + 1
                    if l != label or of_part == PART:
                        part, of_part = part + 1, 0
                label = l
                held.append((i, v))
        if held:
            yield block(held)

    order = ["label", "place", "vec_id"]
    lines = rows.mapInPandas(placed, "vec_id long, label long, place long, vector binary").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return lines.mapInPandas(blocks, "block long, part long, label long, rows int, vectors binary, ids binary, low binary, high binary")


def matrix(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, "i8") for v in values])


def ends_of(windows: list[bytes]) -> np.ndarray:
    """Window ends, anchors x windows x 2; an anchor with fewer windows gets empty ones."""
    each = [np.frombuffer(w, "i8").reshape(-1, 2) for w in windows]
    out = np.full((len(each), max(map(len, each)), 2), (HIGHEST, LOWEST), "i8")
    for i, w in enumerate(each):
        out[i, :len(w)] = w
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: through floating point where no sum can reach 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype("f8") @ b.T.astype("f8")).astype("i8")
    return a @ b.T


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with anything between ``low`` and ``high``."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def streamed(rows: DataFrame, key: str, compute: Callable[[list, list], pd.DataFrame], schema: str, batch_rows: int = 512) -> DataFrame:
    """Per key: holds the rows with flow false, and gives the others to ``compute(held, some)`` in batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, waiting = None, [], []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.key != now or len(waiting) == batch_rows:
                    if waiting:
                        yield compute(held, waiting)
                    waiting = []
                    if row.key != now:
                        now, held = row.key, []
                (waiting if row.flow else held).append(row)
        if waiting:
            yield compute(held, waiting)

    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, "flow").mapInPandas(run, schema)


def reaches(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Anchors by windows against boxes: can the box hold a score of the window? Bounds are anchors x boxes, window ends anchors x windows."""
    return (most[:, None, :] >= low[:, :, None]) & (least[:, None, :] <= high[:, :, None])


def requests(anchors: DataFrame, parts: DataFrame, chunks: int, same: bool, best_only: bool) -> DataFrame:
    """anchor, part: which parts each anchor must read (``best_only``: just the one with the greatest possible score)."""
    def compute(held: list, some: list) -> pd.DataFrame:
        label = np.array([h.label for h in held])
        q, windows = matrix([s.vectors for s in some]), ends_of([s.ids for s in some])
        least, most = bounds(q, matrix([h.low for h in held]), matrix([h.high for h in held])) if held else (np.zeros((len(some), 0), "i8"),) * 2
        can = reaches(least, most, windows[:, :, 0], windows[:, :, 1]).any(1)
        can &= (np.array([s.label for s in some])[:, None] == label[None, :]) == same
        if best_only and held:
            top = np.argmax(np.where(can, most, np.iinfo("i8").min), 1)
            can &= np.arange(len(held))[None, :] == top[:, None]
        a, p = np.nonzero(can)
        return pd.DataFrame({"anchor": np.array([s.id for s in some], "i8")[a], "part": np.array([h.id for h in held], "i8")[p]})

    zones = parts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("key"), F.lit(False).alias("flow"), F.col("part").alias("id"), "label",
                         F.lit(None).cast("binary").alias("vectors"), F.lit(None).cast("binary").alias("ids"), "low", "high")
    asked = anchors.select(F.col("chunk").alias("key"), F.lit(True).alias("flow"), F.col("anchor").alias("id"), "label", F.col("vector").alias("vectors"),
                           F.col("windows").alias("ids"), F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high"))
    return streamed(zones.unionByName(asked), "key", compute, "anchor long, part long")


def scan(anchors: DataFrame, wanted: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, slot, id, score: the best ``k`` rows of each window in each part that an anchor has asked for."""
    def compute(held: list, some: list) -> pd.DataFrame:
        anchor, q = np.array([s.id for s in some], "i8"), matrix([s.vectors for s in some])
        windows = ends_of([s.ids for s in some])
        low, high = windows[:, :, 0].copy(), windows[:, :, 1]
        hits = [np.zeros((0, 4), "i8")]
        if held:
            least, most = bounds(q, matrix([h.low for h in held]), matrix([h.high for h in held]))
        for j, h in enumerate(held):
            needs = reaches(least[:, j:j + 1], most[:, j:j + 1], low, high)[:, :, 0]
            rows = np.flatnonzero(needs.any(1))
            if not len(rows):
                continue
            ids = np.frombuffer(h.ids, "i8")
            s = product(q[rows], np.frombuffer(h.vectors, "i8").reshape(len(ids), -1))
            s[ids[None, :] == anchor[rows, None]] = LOWEST
            for w in range(low.shape[1]):
                at = rows[needs[rows, w]]
                mine_ = s[needs[rows, w]]
                here = np.where((mine_ >= low[at, w, None]) & (mine_ <= high[at, w, None]), mine_, LOWEST)
                last = np.partition(here, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(at), LOWEST)
                x, y = np.nonzero((here >= last[:, None]) & (here > LOWEST))
                hits.append(np.stack([at[x], np.full(len(x), w), -here[x, y], ids[y]], 1))
                low[at, w] = np.maximum(low[at, w], last)
        hit = np.concatenate(hits)
        hit = hit[np.lexsort(hit.T[::-1])]
        start = np.flatnonzero(np.r_[True, (hit[1:, :2] != hit[:-1, :2]).any(1)]) if len(hit) else np.zeros(0, "i8")
        rank = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
        hit = hit[rank < k]
        return pd.DataFrame({"anchor": anchor[hit[:, 0]], "slot": hit[:, 1].astype("i4"), "id": hit[:, 3], "score": -hit[:, 2]})

    key = F.xxhash64("part", "chunk").alias("key")
    flow = wanted.join(anchors, "anchor").select(key, F.lit(True).alias("flow"), F.col("anchor").alias("id"), "label", F.col("vector").alias("vectors"),
                                                 F.col("windows").alias("ids"), F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high"))
    places = wanted.join(anchors.select("anchor", "chunk"), "anchor").select("part", "chunk").distinct()
    held = blocks.join(places, "part").select(key, F.lit(False).alias("flow"), F.col("block").alias("id"), "label", "vectors", "ids", "low", "high")
    return streamed(held.unionByName(flow), "key", compute, "anchor long, slot int, id long, score long")


def best(hits: DataFrame, k: int) -> DataFrame:
    """anchor, slot and the best ``k`` hits as an array of (less, id), first by score, then by id."""
    return hits.distinct().groupBy("anchor", "slot").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k).alias("top"))


def packed(values: str) -> Column:
    """An array of 64-bit integers as bytes."""
    @F.pandas_udf("binary")
    def write(column: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, "i8").tobytes() for x in column], dtype=object)

    return write(values)


def below(scores: str) -> Column:
    """The window of each positive score p, ends of n in 50 p <= 100 n <= 95 p, as bytes; empty where p is negative."""
    @F.pandas_udf("binary")
    def write(column: pd.Series) -> pd.Series:
        return pd.Series([np.array([(-(-p // 2), 95 * p // 100) for p in map(int, x)], "i8").tobytes() for x in column], dtype=object)

    return write(scores)


def part_bounds(blocks: DataFrame) -> DataFrame:
    """part, label and the bounds of all its blocks (``PART`` of them at most)."""
    def run(blocks_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": blocks_["part"].iloc[:1], "label": blocks_["label"].iloc[:1], "low": [matrix(blocks_["low"]).min(0).tobytes()],
                             "high": [matrix(blocks_["high"]).max(0).tobytes()]})

    return blocks.select("part", "label", "low", "high").groupBy("part").applyInPandas(run, "part long, label long, low binary, high binary")


def search(anchors: DataFrame, blocks: DataFrame, parts: DataFrame, chunks: int, k: int, same: bool, name: str) -> DataFrame:
    """anchor, slot, top: each anchor's best ``k`` rows per window. ``anchors`` has anchor, chunk, label, vector and the windows' ends."""
    seeds = stored(scan(anchors, requests(anchors, parts, chunks, same, True), blocks, k, same), f"{name}-seeds")
    reached = best(seeds, k).where(F.size("top") == k).select("anchor", "slot", (-F.element_at("top", -1)["less"]).alias("least"))
    raised = anchors.join(reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known")), "anchor", "left")

    @F.pandas_udf("binary")
    def narrowed(windows: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for w, more in zip(windows, known):
            ends = np.frombuffer(w, "i8").reshape(-1, 2).copy()
            for slot, least in (dict(more).items() if more is not None else ()):
                ends[slot, 0] = max(ends[slot, 0], least)
            out.append(ends.tobytes())
        return pd.Series(out, dtype=object)

    anchors = stored(raised.withColumn("windows", narrowed("windows", "known")).drop("known"), f"{name}-windows")
    return best(scan(anchors, requests(anchors, parts, chunks, same, False), blocks, k, same), k)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (ids divisible by 50) of ``rows`` (vec_id, embedding, label)."""
    good = stored(usable(rows.select("vec_id", "embedding", "label")), "hard-rows")
    blocks = stored(cut_blocks(good), "hard-blocks")
    dims = blocks.agg(F.max(F.length("low") / 8)).first()[0]
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims is None:
        return rows.sparkSession.createDataFrame([], none)
    dims = int(dims)
    parts = stored(part_bounds(blocks), "hard-parts")
    chosen = good.where(F.col("vec_id") % EVERY == 0)
    chunks = max(1, -(-chosen.count() // CHUNK))
    vector = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("q")))
    anchors = chosen.select(F.col("vec_id").alias("anchor"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), "label", vector.alias("whole"),
                            F.array(F.lit(LOWEST + 1), F.lit(HIGHEST)).alias("ends"))
    anchors = stored(anchors.select("anchor", "chunk", "label", packed("whole").alias("vector"), packed("ends").alias("windows")), "hard-anchors")
    positives = stored(search(anchors, blocks, parts, chunks, POSITIVES, True, "hard-positives"), "hard-positives")

    asked = anchors.drop("windows").join(positives.select("anchor", "top", F.transform("top", lambda x: -x["less"]).alias("scores")), "anchor")
    asked = stored(asked.select("anchor", "chunk", "label", "vector", below("scores").alias("windows"), "top"), "hard-asked")
    found = search(asked.drop("top"), blocks, parts, chunks, NEGATIVES, False, "hard-negatives")
    paired = found.withColumnRenamed("top", "hits").join(asked.select("anchor", "top"), "anchor").select(
        F.col("anchor").alias("anchor_id"), F.get("top", F.col("slot")).alias("p"), F.posexplode("hits").alias("rank", "n"))
    return paired.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                         (-F.col("p.less")).alias("positive_score"), (-F.col("n.less")).alias("negative_score"))
