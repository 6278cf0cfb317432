"""SpotSigs fingerprints of documents, and near copies by pruned Jaccard, in Spark expressions alone.

A spot is a common word (anchor); its signature is the chain of the next two content words, anchors skipped. A document's fingerprint is the
sorted set of its signatures' 32-bit hashes as hexadecimal text, so likeness (Jaccard) can be read off two fingerprints. Texts
without a complete chain have their whole word sequence as only signature; texts without words have the empty fingerprint, and two
empty ones are equal (likeness 1). Null texts are empty ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.shared import partitions, stored, text_of

#: Common words of four languages (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el en es esta la las lo los no para pero por que se su un una y"
).split()
CHAIN = 2
MARK = "\x01"
BUCKETS_PER_PARTITION = 4


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The sorted distinct hashes of a non-null text's signatures."""
    anchors = sorted(set(anchors or ANCHORS))
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D\\x01]+"), lambda w: w != "")
    # punctuation at a word's edges is no part of it
    words = F.transform(words, lambda w: F.regexp_replace(w, "^\\p{Punct}++(?=.)|(?<=.)\\p{Punct}++$", ""))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(anchors), F.lit(MARK)).otherwise(w)), " ")
    chains = F.regexp_extract_all(marked, F.lit(f"{MARK}(?=((?:[{MARK} ]++[^{MARK} ]++){{{chain}}}))"), F.lit(1))
    hashes = F.transform(chains, lambda c: F.hash(F.regexp_replace(c, f"[{MARK} ]+", " ")))
    whole = F.when(F.size(words) > 0, F.array(F.hash(F.array_join(words, " ")))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_distinct(F.when(F.size(hashes) > 0, hashes).otherwise(whole)))


def as_text(sigs: Column) -> Column:
    """Eight hexadecimal digits per signature."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature arrays; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 1.0).otherwise(shared / total)


def _buckets(docs: DataFrame) -> tuple[list[int], dict[int, int]]:
    """Borders that cut the ids into even ranges, and the largest id of each range that has rows (a number per range)."""
    n = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    ids = docs.where(F.col("doc_id").isNotNull())
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))})
    top = ids.groupBy(_bucket(F.col("doc_id"), cuts).alias("k")).agg(F.max("doc_id").alias("top")).collect()
    return cuts, {r["k"]: r["top"] for r in top}


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """How many borders are at or below the id; null ids come first of all."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= doc_id)), F.lit(0))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the next document by descending doc_id; the last one's next is the first.

    Rows are dealt into id ranges, and the first row of a range is also dealt, as a guest, to the range above it: one shuffle, no global
    order. Equal ids follow each other; null ids come last.
    """
    cuts, top = _buckets(docs)
    full = sorted(top)
    has_null = F.col("doc_id").isNull()
    above = {k: full[i + 1] for i, k in enumerate(full[:-1])}
    # flat lists by range: expressions don't nest with the number of ranges
    listed = lambda values: F.get(F.array(*[F.lit(values.get(k)).cast("long") for k in range(len(cuts) + 1)]), F.col("__bucket"))
    to = listed({k: above.get(k, full[0]) for k in full}).cast("int")
    guests = F.when(F.col("doc_id") == listed(top), to)
    home = F.coalesce("__bucket", F.lit(0))
    dealt = docs.withColumn("__bucket", _bucket(F.col("doc_id"), cuts))
    if full:  # null ids live in the lowest range, which is read last
        dealt = dealt.withColumn("__bucket", F.when(has_null, full[0]).otherwise(F.col("__bucket")))
    dealt = dealt.withColumn("__to", F.explode(F.array_compact(F.array(F.struct(home.alias("bucket"), F.lit(0).alias("guest")), F.when(
        guests.isNotNull(), F.struct(guests.alias("bucket"), F.lit(1).alias("guest")))))))
    order = Window.partitionBy("__to.bucket").orderBy("__to.guest", F.desc_nulls_last("doc_id"), *columns[:1])
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(F.col("__to.guest") == 0)
    # a table without any id has no ranges: its rows are one run, and the last follows on to itself
    return led.withColumns({f"next_{c}": F.coalesce(f"next_{c}", c) for c in columns}).drop("__to", "__bucket")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many from the start of the next text (or all of it)."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and the likeness to the edited text and to the next document."""
    own = docs.select("doc_id", text_of().alias("text")).withColumn("sigs", signatures(F.col("text")))
    rows = with_next(own, ["text", "sigs"]).withColumn("other", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("other", 256).alias("edited_sha256"), "sigs", "next_sigs",
                       signatures(F.col("other")).alias("other_sigs"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("other_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("other_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a < b, likeness) between different signature sets of at least ``threshold``; the class of equal sets goes by its smallest doc_id.

    Sets are partitioned by length: a pair's lengths differ by a factor of ``threshold`` at most, so each set meets its own range of lengths
    and the next one. Inside, two sets that are alike enough share one of their rarest signatures (as many as may differ, plus one); only
    such pairs are compared, and only if their lengths allow it.
    """
    rows = docs.select("doc_id", signatures(text_of()).alias("sigs"))
    sets = stored(rows.groupBy("sigs").agg(F.min("doc_id").alias("id")).where(F.size("sigs") > 0), "spot-sets")
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    size = F.size("sigs")
    ranked = (sets.select("id", size.alias("n"), F.explode("sigs").alias("sig")).join(counts, "sig")
              .withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("count", "sig")))
              .where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
              .withColumn("range", F.floor(F.log(F.col("n")) / math.log(1 / threshold)).cast("int")))
    keys = ranked.select("sig", "range", "id", "n", F.lit(True).alias("home")).unionByName(
        ranked.select("sig", (F.col("range") + 1).alias("range"), "id", "n", F.lit(False).alias("home")))
    left, right = keys.where("home").alias("l"), keys.alias("r")
    pairs = left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.range") == F.col("r.range")) & (F.col("l.id") != F.col("r.id"))
                      & (F.col("r.home") & (F.col("l.id") < F.col("r.id")) | ~F.col("r.home")) & (F.col("r.n") >= threshold * F.col("l.n")) & (F.col("l.n") >= threshold * F.col("r.n")))
    pairs = pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    one, two = sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold)
