"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds; Spark expressions alone.

Base detectors give exact spans (email, ip, card, phone) and always stay. High-recall generators propose wider, overlapping candidates: any
token around an ``@``, dotted numbers, long digit runs, anything dialled. What the base patterns miss is not known to be wrong, so candidates that no
base match settles are left unlabelled. The trees learn from

* candidates that are valid base spans, and the same data written in a way that the base pattern doesn't know (``VARIANTS``): right;
* candidates whose base match failed its check, candidates that are valid data of another kind, and base spans without what makes them such
  (a domain without a dot, three or five parts, bare digits): wrong.

A candidate that no base span touches is added if it passes its kind's check and its probability reaches the kind's threshold: the lowest with the wanted
precision among labelled candidates, all scored by trees that haven't seen their document.

Null texts are empty ones and have no span. Offsets count code points, ends are exclusive. Spans are found by cutting the whole text at the
matches, so nothing is limited to a prefix. Of overlapping additions the likeliest stays, of equally likely ones the first. Repeated rows are treated alike,
rows without id too; an empty table gives no rows and a model that adds nothing. Own columns named wide, spans or base_<kind> would be replaced: select first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.llm.boosting import Boosted, fit_calibrated
from fraylens.llm.shared import hash_sample, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Documents (drawn by hash) and candidates of a kind that the trees are fitted on at most, and the precision that additions need.
DOCUMENTS, SAMPLE, PRECISION = 20_000, 20_000, 0.95
#: Base patterns. Possessive runs and the left borders only spare the engine hopeless starts inside a run; matches are the plain patterns'.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![^\s,;<>\"])[^\s,;<>\"@]++[\x20]?@[\x20]?[^\s,;<>\"@]++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,8}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,21}+",
    "phone": r"(?:\+[\x20]?)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}+",
}
FEATURES = ("domain_dots", "length", "digits", "digit_ratio", "separators", "dots", "spaces", "plus", "brackets", "letters", "at", "after_letter", "after_space", "before_letter",
            "before_stop", "words_before", "digits_before", "cue")
#: Features that a kind's trees don't see: accidents of how base spans are written (names with digits, the plus that the base pattern asks for).
MASKED = {"email": ("length", "digits", "digit_ratio", "dots", "letters"), "ip": (), "card": ("length", "digit_ratio", "dots"), "phone": ("plus", "length")}
#: Words that announce personal data (fixed values).
CUE = r"(?i)(?:tel|phone|fon|mobile|call|fax|mail|contact|card|visa|ip|host|addr|kontakt|tarjeta|correo|carte)[^A-Za-z]{0,4}$"
CONTEXT = 24
#: Other forms of a valid base span: whether they are still data of that kind, pattern, replacement.
VARIANTS = {
    "email": ((True, "@", " @ "), (False, r"@([^.]*)\..*$", "@$1")),
    "ip": ((False, r"\.[0-9]+$", ""), (False, "$", ".1")),
    "card": ((True, r"[\x20-]?([0-9]{4})(?=[\x20-]?[0-9])", "$1."),),
    "phone": ((True, r"^\+[0-9]{1,3}[\x20.-]*(?=.*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9])", ""), (False, "[^0-9]", "")),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, "[.]"), part)
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _validity(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["value"])


def _invalidity(kind: str) -> Callable[[Column], Column]:
    return lambda s: ~valid(kind, s["value"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _cut(df: DataFrame, text: str, patterns: dict[str, str], prefix: str, hint: Column) -> DataFrame:
    """Per kind the matches, the pieces between them, and the matches' starts. ``hint``: rows that can match at all."""
    none = F.array().cast("array<string>")
    for kind, pattern in patterns.items():
        found, rest, start = (f"__{prefix}_{kind}_{x}" for x in ("found", "rest", "start"))
        need = F.contains(F.col(text), F.lit("@" if kind == "email" else "+")) if kind == "email" or (kind, prefix) == ("phone", "base") else hint
        df = df.withColumn(found, F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
        df = df.withColumn(rest, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
        at = F.aggregate(
            F.zip_with(F.slice(rest, 1, F.size(found)), F.col(found), lambda r, f: F.struct(F.char_length(r).alias("gap"), F.char_length(f).alias("own"))),
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts")),
            lambda a, x: F.struct((a["pos"] + x["gap"] + x["own"]).alias("pos"), F.concat(a["starts"], F.array(a["pos"] + x["gap"])).alias("starts")),
            lambda a: a["starts"])
        df = df.withColumn(start, F.when(F.size(found) > 0, at).otherwise(F.array().cast("array<int>")))
    return df


def _spans(kind: str, prefix: str) -> Column:
    """start, end, value, the piece before and the one after, of each match of a kind."""
    found, rest, start = (F.col(f"__{prefix}_{kind}_{x}") for x in ("found", "rest", "start"))
    return F.transform(start, lambda s, i: F.struct(
        F.lit(kind).alias("kind"), s.alias("start"), (s + F.char_length(F.get(found, i))).alias("end"), F.get(found, i).alias("value"),
        F.right(F.get(rest, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(rest, i + 1), F.lit(2)).alias("after")))


def base_spans(df: DataFrame, text: str = "text", failed: bool = False) -> DataFrame:
    """Adds per kind an array of the valid base spans by start (columns base_email, base_ip, base_card, base_phone); ``failed``: also matches that fail."""
    hint = F.col(text).rlike("[0-9]")
    df = _cut(df, text, BASE, "base", hint)
    for kind in KINDS:
        df = df.withColumn(f"base_{kind}", F.filter(_spans(kind, "base"), _validity(kind)))
    if failed:
        df = df.withColumn("__failed", F.concat(*(F.filter(_spans(k, "base"), _invalidity(k)) for k in KINDS)))
    return df.drop(*(f"__base_{k}_{x}" for k in KINDS for x in ("found", "rest", "start")))


def features(s: Column) -> list[Column]:
    """Format and context of a candidate, without the checks that make a base span valid."""
    v, before, after = s["value"], s["before"], s["after"]
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.char_length(v).cast("double")
    digits = count(v, "[0-9]")
    return [count(F.regexp_extract(v, "@(.*)$", 1), "[.]"), n, digits, digits / n, count(v, r"[\x20().-]+"), count(v, "[.]"), count(v, " "), yes(F.startswith(v, F.lit("+"))), count(v, "[()]"), count(v, r"\p{L}"),
            count(v, "@"), yes(before.rlike(r"\p{L}$")), yes(before.rlike(r"(?:^|\s)$")), yes(after.rlike(r"^\p{L}")), yes(after.rlike(r"^(?:$|[\s.,;!?])")),
            count(before, r"\p{L}+"), count(before, "[0-9]"), yes(before.rlike(CUE))]


def _wide(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__raw``, all generators' candidates, and ``__all``, all valid base spans."""
    df = _cut(df, text, WIDE, "wide", F.col(text).rlike("[0-9]"))
    df = df.withColumn("__raw", F.concat(*(_spans(k, "wide") for k in KINDS)))
    return df.withColumn("__all", F.concat(*(f"base_{k}" for k in KINDS))).drop(*(f"__wide_{k}_{x}" for k in KINDS for x in ("found", "rest", "start")))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _equal(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])


def checked(kind: Column, value: Column) -> Column:
    """``valid`` of a candidate of any kind."""
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, valid(k, value)).otherwise(out)
    return out


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base spans per kind and ``wide``: the candidates that no base span touches and that pass their kind's check, with features."""
    df = _wide(base_spans(df, text), text)
    untouched = F.filter("__raw", lambda s: ~F.exists("__all", lambda b: _overlaps(b, s)))
    wide = F.transform(F.filter(untouched, lambda s: checked(s["kind"], s["value"])), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*features(s)).alias("x")))
    return df.withColumn("wide", wide).drop("__raw", "__all")


def _variant(kind: str, still: bool, pattern: str, put: str) -> Callable[[Column], Column]:
    """A base span in another form, as a labelled candidate."""
    def other(s: Column) -> Column:
        written_ = s.withField("value", F.regexp_replace(s["value"], pattern, put))
        return F.struct(F.lit(kind).alias("kind"), F.lit(still).alias("right"), F.array(*features(written_)).alias("x"))

    return other


def labelled(df: DataFrame, text: str = "text") -> DataFrame:
    """kind, right, x (features), doc (hash of the id) of every labelled candidate; ``df`` has doc_id."""
    df = _wide(base_spans(df, text, failed=True), text)
    wrong = lambda s: F.exists("__failed", lambda b: _equal(b, s)) | F.exists("__all", lambda b: (b["kind"] != s["kind"]) & _overlaps(b, s))
    right = lambda s: F.exists("__all", lambda b: _equal(b, s))
    found = F.transform("__raw", lambda s: F.struct(s["kind"].alias("kind"), F.when(right(s), True).when(wrong(s), False).alias("right"), F.array(*features(s)).alias("x")))
    parts = [F.filter(found, lambda s: s["right"].isNotNull())]
    for kind in KINDS:
        for still, pattern, put in VARIANTS[kind]:
            parts.append(F.transform(f"base_{kind}", _variant(kind, still, pattern, put)))
    return df.select(F.xxhash64("doc_id", text).alias("doc"), F.explode(F.concat(*parts)).alias("c")).select("doc", "c.*")


class Model:
    """One boosted model and threshold per kind."""

    def __init__(self, trees: dict[str, Boosted], cuts: dict[str, float]):
        self.trees, self.cuts = trees, cuts


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest probability from which on labelled candidates are right often enough; 2 (never) if none is."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Probability of each row by trees fitted on the other folds; -1 where those have one class only."""
    out = np.full(len(y), -1.0)
    for k in np.unique(folds):
        rest = folds != k
        if 0 < y[rest].sum() < rest.sum():
            out[~rest] = fit_calibrated(x[rest], y[rest], folds[rest], trees=20, depth=3).probability(x[~rest])
    return out


def fit(docs: DataFrame, documents: int = DOCUMENTS, sample: int = SAMPLE) -> Model:
    """From the candidates of about ``documents`` documents, at most ``sample`` candidates of each kind; only their numbers come to the driver.

    Documents are drawn by a 64-bit hash, so any number of them leaves as many. A kind without right and wrong candidates adds nothing.
    """
    total = max(docs.count(), 1)
    drawn = docs.select("doc_id", text_of().alias("text"))
    if documents < total:
        drawn = drawn.where(F.xxhash64(F.lit(5), "doc_id", "text") < F.lit(int(documents / total * (1 << 64)) - (1 << 63)))
    rows = labelled(drawn).withColumn("key", F.xxhash64("doc", "kind", "right", "x"))
    trees, cuts = {}, {}
    got = hash_sample(stored(rows, "pii-candidates"), "key", len(KINDS) * sample).collect()
    for kind in KINDS:
        own = sorted((r for r in got if r["kind"] == kind), key=lambda r: (r["key"], r["x"]))[:sample]
        x = np.array([r["x"] for r in own], "f8").reshape(-1, len(FEATURES))
        x[:, [FEATURES.index(f) for f in MASKED[kind]]] = 0
        y, folds = np.array([r["right"] for r in own], "f8"), np.array([r["doc"] % 4 for r in own])
        trees[kind] = fit_calibrated(x, y, folds, trees=20, depth=3)
        p = out_of_fold(x, y, folds)
        cuts[kind] = threshold(p[p >= 0], y[p >= 0]) if (p >= 0).any() and 0 < y.sum() < len(y) else 2.0
    return Model(trees, cuts)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns plus base_<kind> arrays and ``spans``: (kind, start, end) of base spans and selected candidates, by kind, then start."""
    df = candidates(docs, text)

    def margin(c: Column) -> Column:
        x, out = [c["x"][k] for k in range(len(FEATURES))], F.lit(0.0)
        for kind in KINDS:
            out = F.when(c["kind"] == kind, model.trees[kind].margin_column(x)).otherwise(out)
        return out

    def chance(c: Column) -> Column:
        out = F.lit(0.0)
        for kind in KINDS:
            out = F.when(c["kind"] == kind, model.trees[kind].probability_column(c["m"])).otherwise(out)
        return out

    def enough(c: Column) -> Column:
        return F.lit(False) if not (cuts := {k: v for k, v in model.cuts.items() if v <= 1}) else reduce(
            or_, [(c["kind"] == k) & (c["p"] >= v) for k, v in cuts.items()])

    place = lambda c: (c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    df = df.withColumn("__open", F.transform("wide", lambda c: F.struct(*place(c), margin(c).alias("m"))))
    df = df.withColumn("__open", F.transform("__open", lambda c: F.struct(*place(c), chance(c).alias("p"))))
    df = df.withColumn("__chosen", F.filter("__open", enough))
    # of overlapping additions the likeliest stays, of equal ones the first
    beats = lambda o, c: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (
        (o["p"] > c["p"]) | (o["p"] == c["p"]) & (F.struct(o["start"], o["end"], o["kind"]) < F.struct(c["start"], c["end"], c["kind"])))
    df = df.withColumn("__added", F.filter("__chosen", lambda c: ~F.exists("__chosen", lambda o: beats(o, c))))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.concat(*(F.array_sort(F.concat(F.transform(f"base_{k}", plain), F.transform(F.filter("__added", _is(k)), plain))) for k in KINDS))
    return df.withColumn("spans", spans).drop("wide", "__open", "__chosen", "__added")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets. Overlapping base spans are replaced together."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = F.aggregate(
        ordered, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(s["start"] < a["pos"], F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), a["parts"].alias("parts"))).otherwise(F.struct(
            s["end"].alias("pos"), F.concat(a["parts"], F.array(F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["pos"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)
