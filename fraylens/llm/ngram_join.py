"""Jaccard join of word n-gram sets by filters of several global orders.

Two sets that are alike enough share a token among the first few of either set under *any* order of all tokens, because each may miss only a few
of the other's. The first order is by rarity (number of sets with the token, counted over all documents), two more are by independent hashes. Pairs
come from the first order's prefixes; those that also share prefix tokens under the other orders are verified on the complete sets. A token of one
set only can be in no other, so it uses up a place of the prefix and is never sent on; a set with more of them than it may miss is out at once.

Crowded tokens. A token of fewer than ``FREQUENT`` sets pairs its holders directly. Holders of any other token form the family of one of them (the
head, with the fewest tokens of its own). Each member is compared with the head alone, which gives its difference d from the head's shared tokens. With
``slack(x) = (100 + s) * |d(x)| - (100 - s) * |x|``, sets x and y link whenever ``slack(x) + slack(y) <= 0``: all of these link to the member of least
slack. Any other pair of the family must share a token of their differences, again among the first few in order of rarity, so only the few members
far from the centre are joined, on (head, token). A family of near copies thus costs a row per member instead of all its pairs, and no link is lost.

Equal sets are one node. Tokens are 56-bit hashes, nodes 64-bit ones. Counting deals tokens to buckets of about ``BUCKET``, packed by batch; a token that ``FREQUENT``
sets of one batch share is sent once by that batch, and copies of a text once by a task, so neither fills a bucket.

Null and empty texts have no set and are linked with nothing. Repeated rows and equal texts belong together; a row without id has its group's id, if it
has one. Other columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.llm.shared import discard, extended, partitions, release, stored, text_of
from fraylens.llm.simhash import components, shingle_hashes

SHINGLE, PERCENT = 3, 90
FREQUENT, HELD, BUCKET = 64, 1_000_000, 1_000_000
TOKEN_BITS = 56


def token_set(text: str, size: int) -> np.ndarray:
    """Distinct 56-bit hashes of the text's shingles."""
    return np.unique(shingle_hashes(text.encode().lower().split(), size) >> np.uint64(64 - TOKEN_BITS)).astype("i8")


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, node (of equal sets; null without words) and number of distinct shingles of every row."""
    def run(texts: list[str]) -> dict:
        sets = [token_set(t, size) for t in texts]
        return {"node": [node_of(s) if len(s) else None for s in sets], "n_shingles": [len(s) for s in sets]}

    return extended(docs, ("doc_id",), "node long, n_shingles long", lambda: run)


#: Tokens of several sets in one row: ``key`` is a bucket of tokens or a group of nodes, lists are parallel but for ``tokens``, which has ``sizes`` of each.
PACKED = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("nodes", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                    ("tokens", pa.list_(pa.int64()))])
PACKED_SQL = "key long, kind tinyint, nodes array<long>, ns array<int>, sizes array<int>, tokens array<long>"
#: Kinds of rows: tokens to be counted, tokens known to be frequent, and news of frequent tokens without their sets.
PLAIN, READY, NEWS = 0, 1, 2


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _packed(kind: int, key: np.ndarray, node: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """A row per key. Arguments are by token and sorted by key, then node."""
    run = _runs(key, node) if len(key) else np.zeros(0, "i8")
    row = _runs(key[run]) if len(run) else np.zeros(0, "i8")
    cuts = pa.array(np.append(row, len(run)), pa.int32())
    ends = np.append(run, len(tokens))
    lists = lambda values, kind_: pa.ListArray.from_arrays(cuts, pa.array(values, kind_))
    return pa.RecordBatch.from_arrays([
        pa.array(key[run[row]], pa.int64()), pa.array(np.full(len(row), kind), pa.int8()), lists(node[run], pa.int64()), lists(n[run], pa.int32()),
        lists(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends[np.append(row, len(run))], pa.int32()), pa.array(tokens, pa.int64()))], schema=PACKED)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """kind, node, n and size of every set in the rows, and all tokens."""
    flat = lambda name: pc.list_flatten(table.column(name)).to_numpy()
    sets = pc.list_value_length(table.column("nodes")).to_numpy()
    return np.repeat(table.column("kind").to_numpy(), sets), flat("nodes"), flat("ns"), flat("sizes"), flat("tokens")


def _dealt(sets: list[np.ndarray], nodes: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: tokens by bucket; tokens frequent here as ready rows of their nodes and once as news for their bucket."""
    size = np.fromiter(map(len, sets), "i8", len(sets))
    tokens, own, node = np.concatenate(sets), np.repeat(np.arange(len(sets)), size), np.array(nodes, "i8")
    order = np.argsort(tokens, kind="stable")
    tokens, own = tokens[order], own[order]
    first = _runs(tokens)
    count = np.diff(np.append(first, len(tokens)))
    often = np.repeat(count >= FREQUENT, count)
    t, o = tokens[often] | np.int64(FREQUENT) << np.int64(TOKEN_BITS), own[often]
    by = np.lexsort((node[o], node[o] % buckets))
    yield _packed(READY, (node[o] % buckets)[by], node[o][by], size[o][by], t[by])
    t = tokens[first[count >= FREQUENT]]
    by = np.argsort(t % buckets, kind="stable")
    yield _packed(NEWS, (t % buckets)[by], np.zeros(len(t), "i8"), np.zeros(len(t), "i8"), t[by])
    t, o = tokens[~often], own[~often]
    by = np.lexsort((node[o], t % buckets))
    yield _packed(PLAIN, (t % buckets)[by], node[o][by], size[o][by], t[by])


def deal(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """All tokens by bucket; each distinct set once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        sets, nodes, held = [], [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = token_set(text, size)
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                seen.add(node)
                sets.append(tokens)
                nodes.append(node)
                held += len(tokens)
                if held > HELD:
                    yield from _dealt(sets, nodes, buckets)
                    sets, nodes, held = [], [], 0
        if sets:
            yield from _dealt(sets, nodes, buckets)

    return docs.select(text_of().alias("text")).where("text != ''").mapInArrow(run, PACKED_SQL)


def counted(groups: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: of each node the tokens that other sets have too, as ``holders << 56 | token`` (``FREQUENT`` stands for that many or more), by node group."""
    def run(table: pa.Table) -> pa.Table:
        kind, node, n, size, values = _unpacked(table)
        rows = np.arange(len(node))
        use = np.zeros(len(node), bool)
        use[rows[kind == PLAIN][np.unique(node[kind == PLAIN], return_index=True)[1]]] = True  # a node comes once from each task that has it
        of = np.repeat(rows, size)
        plain, owner = values[use[of]], of[use[of]]
        distinct, back, count = np.unique(plain, return_inverse=True, return_counts=True)
        news = np.unique(values[(kind == NEWS)[of]])
        holders = np.where(np.isin(distinct, news), FREQUENT, np.minimum(count, FREQUENT)).astype("i8")[back]
        shared, done = holders > 1, (kind == READY)[of]
        packed = np.concatenate([plain[shared] | holders[shared] << np.int64(TOKEN_BITS), values[done]])
        owner = np.concatenate([owner[shared], of[done]])
        group = node[owner] % groups
        by = np.lexsort((packed, node[owner], group))
        packed, owner, group = packed[by], owner[by], group[by]
        fresh = np.ones(len(packed), bool)
        fresh[1:] = (packed[1:] != packed[:-1]) | (node[owner[1:]] != node[owner[:-1]])
        packed, owner, group = packed[fresh], owner[fresh], group[fresh]
        return pa.Table.from_batches([_packed(PLAIN, group, node[owner], n[owner], packed)])

    return run


def assembled(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one group of nodes: node, n, own and tokens, rarest first, of the sets that may have a partner."""
    def run(table: pa.Table) -> pa.Table:
        _, node, n, size, tokens = _unpacked(table)
        of = np.repeat(np.arange(len(node)), size)
        by = np.lexsort((tokens, node[of]))
        tokens, of = tokens[by], of[by]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (node[of[1:]] != node[of[:-1]])
        tokens, of = tokens[fresh], of[fresh]
        at = _runs(node[of]) if len(of) else np.zeros(0, "i8")
        ends = np.append(at, len(of))
        total, shared = n[of[at]].astype("i8"), np.diff(ends)
        may = total - -(-total * percent // 100) + 1 - (total - shared) > 0
        keep = np.repeat(may, shared)
        cuts = np.append(0, np.cumsum(shared[may]))
        return pa.table({"node": pa.array(node[of[at]][may], pa.int64()), "n": pa.array(total[may], pa.int32()), "own": pa.array((total - shared)[may], pa.int32()),
                         "tokens": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens[keep], pa.int64()))})

    return run


def prefix(n: Column, percent: int) -> Column:
    """How many first tokens of a set of ``n`` must hold one of any set alike."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def shared_sets(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """node, n, own (tokens of that set only), tokens (the others, rarest first) and the prefixes under three orders, of sets that may have a partner."""
    parts = deal(docs, size, buckets).groupBy("key").applyInArrow(counted(buckets), PACKED_SQL)
    whole = parts.groupBy("key").applyInArrow(assembled(percent), "node long, n int, own int, tokens array<long>")
    need = (prefix(F.col("n"), percent) - F.col("own")).cast("int")
    hashed = lambda k: F.transform(F.slice(F.array_sort(F.transform("tokens", lambda t: F.struct(F.xxhash64(t, F.lit(k)).alias("h"), t.alias("t")))),
                                           F.lit(1), need), lambda x: x["t"])
    return whole.select("node", "n", "own", "tokens", F.slice("tokens", F.lit(1), need).alias("first"), hashed(1).alias("second"), hashed(2).alias("third"))


def alike(shared: Column, total: Column, percent: int) -> Column:
    return shared * (100 + percent) >= total * percent


def sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def renamed(sets: DataFrame, to: str, *columns: str) -> DataFrame:
    return sets.select(F.col("node").alias(to), *(F.col(c).alias(f"{to}_{c}") for c in columns))


def families(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """head, node and the member's difference from the head's shared tokens: n, own, extra, missing (counts), delta (tokens, rarest first)."""
    heads = postings.groupBy("token").agg(F.min(F.struct("own", "node")).alias("h"), F.count("*").alias("k")).where("k > 1").select("token", F.col("h.node").alias("head"))
    pairs = postings.join(heads, "token").select("head", "node").distinct()
    both = pairs.join(renamed(sets, "head", "tokens"), "head").join(sets.select("node", "n", "own", "tokens"), "node")
    extra, missing = F.array_except("tokens", "head_tokens"), F.array_except("head_tokens", "tokens")
    return both.select("head", "node", "n", "own", extra.alias("extra"), missing.alias("missing")).select(
        "head", "node", "n", "own", F.size("extra").alias("extra"), F.size("missing").alias("missing"), F.array_sort(F.concat("extra", "missing")).alias("delta"))


def family_pairs(members_: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links a, b to each family's centre; pairs a, b that are left to compare)."""
    apart, both = 100 - percent, 100 + percent
    d = F.col("own") + F.col("extra") + F.col("missing")
    m = members_.withColumns({"d": d, "slack": both * d - apart * F.col("n")})
    centre = m.groupBy("head").agg(F.min(F.struct("slack", "node")).alias("c")).select("head", F.col("c.slack").alias("least"), F.col("c.node").alias("centre"))
    m = m.join(centre, "head").withColumn("open", F.col("slack") + F.col("least") > 0)
    links = m.where(~F.col("open") & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    # at most this many tokens of a difference are not in the other's; tokens of one set only are the first of them
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * apart / both)
    few = (most + 1 - F.col("own")).cast("int")
    entries = m.where(few > 0).select("head", "node", "n", "d", "extra", "missing", "open", F.explode(F.slice("delta", F.lit(1), few)).alias("token"))
    x, y = entries.where("open").alias("x"), entries.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c("x", "n") + c("y", "n")
    least = c("x", "d") + c("y", "d") - F.floor(total * apart / both)
    room = F.least(c("x", "extra"), c("y", "extra")) + F.least(c("x", "missing"), c("y", "missing"))
    on = (c("x", "head") == c("y", "head")) & (c("x", "token") == c("y", "token")) & (c("x", "node") != c("y", "node")) & (
        ~c("y", "open") | (c("x", "node") < c("y", "node"))) & sizes_fit(c("x", "n"), c("y", "n"), percent) & (least <= 2 * room)
    left = x.join(y, on).select(F.least(c("x", "node"), c("y", "node")).alias("a"), F.greatest(c("x", "node"), c("y", "node")).alias("b"))
    return links, left


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that share prefix tokens under every order and are alike on the complete sets."""
    columns = ("n", "tokens", "second", "third")
    both = pairs.join(renamed(sets, "a", *columns), "a").join(renamed(sets, "b", *columns), "b")
    met = both.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
    return met.where(alike(F.size(F.array_intersect("a_tokens", "b_tokens")), F.col("a_n") + F.col("b_n"), percent)).select("a", "b")


def candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sure links; pairs to verify) among ``shared_sets``: by rare tokens directly, by all others through families."""
    postings = sets.select("node", "n", "own", F.explode("first").alias("token"))
    rare = F.col("token") < F.lit(FREQUENT << TOKEN_BITS)
    x, y = postings.where(rare).alias("x"), postings.where(rare).alias("y")
    near = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & sizes_fit(F.col("x.n"), F.col("y.n"), percent)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    sure, left = family_pairs(stored(families(postings.where(~rare), sets), "ngram-families"), percent)
    return sure, near.unionByName(left)


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, its own included) of every row."""
    rows = stored(members(docs, size), "ngram-members")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // BUCKET))
    sets = stored(shared_sets(docs, size, percent, buckets), "ngram-sets")
    sure, pairs = candidates(sets, percent)
    edges = stored(sure.unionByName(verified(pairs.distinct(), sets, percent)), "ngram-links")
    discard(sets)
    label = components(edges, "ngram")
    first = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = stored(first.join(label, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label")), "ngram-named")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    reached = stored(named.join(smallest, "label").select("node", "component_id"), "ngram-components")
    return rows.join(reached, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
