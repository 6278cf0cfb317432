"""URL filter: rules where one fits, else boosted trees over lexical features, all in Spark expressions.

The labelled URLs are those that a rule decides; what the rules say of them teaches the trees (at most ``SAMPLE`` of them are fitted on). Statistics are
the share of blocked URLs by host suffix (last label) and by the path's beginning (first segment), counted over all labelled URLs; an entry rests on ``PRIOR`` rows
at least and is drawn to the overall share by as many, so that no URL's own label tells. A suffix whose labelled URLs all say the same counts as unknown and its URLs aren't fitted on (unless there are no others):
they only repeat a rule, which would be taken for a property of everything under an unknown suffix. The path's beginning carries over. Probabilities are calibrated on whole suffixes that the fold's trees haven't seen, and on whole hosts where suffixes can't be held out.

Every suffix and beginning with ``PRIOR`` labelled rows has its entry, however many there are; URLs of rarer ones get the overall share. A table of up to ``ENTRIES``
entries is sent to the tasks and pages don't move; a larger one is joined by a shuffle, where adaptive skew joins split the frequent keys.
Null URLs and those without ``://`` have empty host and path; no rule fits them and the model judges what is there. Repeated rows are judged alike; an empty
table gives no rows. Own columns named host, path, rule, verdict or block_score are replaced, all others are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.llm.boosting import Boosted, fit_calibrated
from fraylens.llm.shared import hash_sample, stored

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE = 20_000
#: Weight of the overall share in a suffix' share of blocked URLs, in rows.
PRIOR = 20.0
#: Entries of a table of statistics that is sent to the tasks; larger ones are joined by a shuffle.
ENTRIES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "labels", "depth", "path_length", "digit_ratio", "host_digits", "entropy", "parameters", "fragment", "hyphens", "secure", "extension", "suffix_blocked", "suffix_seen", "path_blocked", "path_seen")


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("__rest", "^[^/?#]*", 0)
    return df.withColumns({
        "host": F.translate(raw, UPPER, LOWER),
        "path": F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1),
    }).drop("__rest")


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what)).cast("double")


def lexical(url: Column) -> list[Column]:
    """All features but the suffix statistics, of a non-null URL."""
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))

    def share(c: Column) -> Column:
        p = (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
        return F.when((c != "") & (p > 0), -p * F.log2(p)).otherwise(0.0)

    host, path = F.col("host"), F.col("path")
    return [n, F.char_length(host).cast("double"), _count(host, "[.]") + 1, _count(path, "/"), F.char_length(path).cast("double"), _count(url, "[0-9]") / n,
            _count(host, "[0-9]"), F.aggregate(letters, F.lit(0.0), lambda a, c: a + share(c)), _count(url, "[?&][^=&#]+="), F.contains(url, F.lit("#")).cast("double"),
            _count(url, "-"), url.startswith("https").cast("double"), F.when(path.rlike("[.][A-Za-z0-9]{1,5}$"), 1.0).otherwise(0.0)]


def counted(labelled: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Labelled and blocked rows by ``keys``, of all that have ``PRIOR`` rows."""
    return labelled.groupBy(*keys).agg(F.sum("__hit").alias(f"{name}_hits"), F.count("*").alias(f"{name}_seen")).where(F.col(f"{name}_seen") >= F.lit(PRIOR))


def sent(entries: DataFrame, name: str) -> DataFrame:
    """The written table, with a broadcast hint if it is small enough."""
    entries = stored(entries, name)
    return F.broadcast(entries) if entries.count() <= ENTRIES else entries


def described(parsed: DataFrame, url: str) -> DataFrame:
    """Adds the features ``__x``; ``parsed`` has ``__says``, ``__suffix`` and ``__first``."""
    labelled = parsed.where(F.col("__says").isNotNull()).select("__suffix", "__first", (F.col("__says") == "block").cast("double").alias("__hit"))
    all_ = labelled.agg(F.sum("__hit").alias("hits"), F.count("*").alias("n")).first()
    prior = (all_["hits"] or 0.0) / max(all_["n"], 1)
    suffix = counted(labelled, ("__suffix",), "__s").where((F.col("__s_hits") > 0) & (F.col("__s_hits") < F.col("__s_seen")))
    path = counted(labelled, ("__first",), "__p")
    known = parsed.join(sent(suffix, "url-suffixes"), "__suffix", "left").join(sent(path, "url-paths"), "__first", "left")
    zero = F.lit(0.0)
    n = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    # own labels stay in: leaving them out would give labelled rows two values by their label, and away with it
    seen, hits, passed, blocked = (n(c) for c in ("__s_seen", "__s_hits", "__p_seen", "__p_hits"))
    share = lambda h, k: (h + PRIOR * prior) / (k + PRIOR)
    text = F.coalesce(F.col(url), F.lit(""))
    # how much is known, in thirds of a digit: exact numbers would only tell suffixes apart
    weight = lambda k: F.floor(3 * F.log10(k + 1)).cast("double")
    known = known.withColumn("__mixed", F.col("__s_seen").isNotNull())
    return known.withColumn("__x", F.array(*lexical(text), share(hits, seen), weight(seen), share(blocked, passed), weight(passed))).drop(
        *(f"__{a}_{b}" for a in "sp" for b in ("hits", "seen")))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = SAMPLE, url: str = "url") -> DataFrame:
    """All columns plus host, path, rule, verdict and the model's block_score."""
    rule, verdict = rule_of(rules)
    parsed = host_and_path(pages, url).withColumns({"rule": rule, "__says": verdict})
    parsed = parsed.withColumns({"__suffix": F.substring_index("host", ".", -1), "__first": F.regexp_extract("path", "^/[^/]*/?", 0)})
    rows = described(parsed, url)
    labelled = rows.where(F.col("__says").isNotNull())
    mixed = labelled.where("__mixed")
    model = fit((labelled if mixed.isEmpty() else mixed).select("__x", "__says", F.xxhash64(url).alias("__key"), F.xxhash64("__suffix").alias("__of"),
                                                               F.xxhash64("host").alias("__host")), sample)
    x = [F.col("__x")[k] for k in range(len(FEATURES))]
    scored = rows.withColumn("__margin", model.margin_column(x)).withColumn("block_score", model.probability_column(F.col("__margin")))
    scored = scored.withColumn("verdict", F.coalesce("__says", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
    return scored.drop("__suffix", "__first", "__says", "__x", "__mixed", "__margin")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees from at most ``sample`` labelled rows (features, verdict); a few numbers each come to the driver."""
    rows = hash_sample(labelled, "__key", sample).collect()
    x = np.array([r["__x"] for r in rows], "f8").reshape(-1, len(FEATURES))
    y = np.array([r["__says"] == "block" for r in rows], "f8")
    model = None
    for folds in (np.array([r["__of"] for r in rows]), np.array([r["__host"] % 8 for r in rows])):
        usable = [k for k in np.unique(folds) if 0 < y[folds != k].sum() < (folds != k).sum()]
        held = np.isin(folds, usable)
        if held.any() and 0 < y[held].sum() < held.sum():
            model = fit_calibrated(x, y, folds, trees=40, depth=3)
            break
    return model or fit_calibrated(x, y, np.arange(len(y)) % 4, trees=40, depth=3)
