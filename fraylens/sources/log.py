"""Combat log text to typed events. Everything up to ``project_events`` is narrow: no shuffle.

A line is ``M/D/YYYY HH:MM:SS.mmm±Z``, two blanks, an event name and comma-separated
parameters with quoted strings, ``[arrays]`` and ``(tuples)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraylens.functions import classify as C
from fraylens.functions import lookups as L
from fraylens.operators.ordered import carry, upto
from fraylens.session import stored

STAMP = r"^(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}:\d{2}:\d{2}\.\d{3})([-+]\d+)\s\s(.+)$"
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ARRAY = r"\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]"
_TUPLE = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
FIELD = rf'(?:^|,)((?:[^,"\[(]++|{_QUOTED}|{_ARRAY}|{_TUPLE}|["\[(])*+)'
MARK = "\u0001"
# a quoted string, a bracket, a comma, a run of anything else, or a quote that never ends
_PIECE = rf'{_QUOTED}|[\[\](),]|[^"\[\](),]++|"'
_BRACKET = rf'{_QUOTED}|[\[\]()]'


def _matched(levels: int) -> str:
    """Pattern of one bracketed text of at most ``levels`` levels in which each bracket is closed by its own kind and quoted strings are whole."""
    inside = rf'[^"\[\]()]++|{_QUOTED}' + (f"|{_matched(levels - 1)}" if levels > 1 else "")
    return rf"(?:\[(?:{inside})*+\]|\((?:{inside})*+\))"


#: Lines of brackets that match and are two deep at most; what stands between two top commas, its brackets matching and up to ``LEVELS`` deep.
LEVELS = 5
SHALLOW = rf'^(?:[^"\[\]()]++|{_QUOTED}|{_matched(2)})*+\z'
PART = rf'(?:(?<=,)|^)(?:[^,"\[\]()]++|{_QUOTED}|{_matched(LEVELS)})*+'
SPECIAL = ["COMBAT_LOG_VERSION", "ZONE_CHANGE", "MAP_CHANGE", "ENCOUNTER_START", "ENCOUNTER_END",
           "CHALLENGE_MODE_START", "CHALLENGE_MODE_END", "COMBATANT_INFO"]


#: Splits whose line offsets (some 40 bytes each) are sent to every task; with more of them lines are joined to their split's offset by shuffle.
OFFSETS_SENT = 500_000


def raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file_id, block (offset of the input split) and value of every line, and ``at``: a number that counts the lines of a task one by one."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value")


def line_offsets(raw: DataFrame) -> DataFrame:
    """Per split: the file's lines before it, its own number of lines and the number of its first one. A row per split, windows per file."""
    splits = raw.groupBy("file_id", "block").agg(F.min("at").alias("first_at"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(F.xxhash64("file_id").alias("__file"), F.col("block").alias("__block"), "first_at", "lines",
                         F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))


def read_log(spark: SparkSession, paths: str | Sequence[str], guild_id: int = 1) -> DataFrame:
    """Lines with file and position; blank and ``#`` lines are skipped.

    ``line_no`` is the physical line of the file from 1, the same at every ingest and for any size of the splits: a first pass counts the lines of each
    split when this is called, their prefix sums are added to the position inside the split. ``block`` is the offset of the split; (file_id, line_no)
    is the file order and ``block`` never falls along it, so it cuts a huge file into buckets for order-dependent columns. Files that change between
    the passes, or another cut of them, are an error and never a wrong number.
    """
    raw = raw_lines(spark, paths)
    offsets = stored(line_offsets(raw), "line-offsets")
    few = offsets.count() <= OFFSETS_SENT
    lines = raw.join(F.broadcast(offsets) if few else offsets, (F.xxhash64("file_id") == F.col("__file")) & (F.col("block") == F.col("__block")), "left")
    inside = F.col("at") - F.col("first_at")
    sound = F.coalesce((inside >= 0) & (inside < F.col("lines")), F.lit(False))
    number = F.when(sound, F.col("before") + inside + 1).otherwise(F.raise_error(F.lit("log files changed while they were read")).cast("long"))
    return lines.select(
        F.lit(guild_id if guild_id and guild_id > 0 else 1).cast("long").alias("guild_id"), "file_id", "block", number.alias("line_no"),
        F.rtrim("value").alias("line")).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))


def _opens(piece: Column) -> Column:
    return piece.isin("[", "(")


def _closes(piece: Column) -> Column:
    return piece.isin("]", ")")


def nesting(text: Column) -> Column:
    """Struct of the greatest depth of brackets outside quotes, whether one closed that wasn't open, and how many are open at the end."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(False).alias("below"))

    def step(a: Column, piece: Column) -> Column:
        now = a["now"] + F.when(_opens(piece), 1).when(_closes(piece), -1).otherwise(0)
        return F.struct(F.greatest(now, F.lit(0)).alias("now"), F.greatest(a["most"], now).alias("most"), (a["below"] | (now < 0)).alias("below"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_BRACKET), F.lit(0)), start, step, lambda a: F.struct(
        a["most"].alias("depth"), a["below"].alias("below"), a["now"].alias("open")))


def balanced(text: Column) -> Column:
    """Whether every bracket outside quotes has its other half."""
    return F.exists(F.array(nesting(text)), lambda n: ~n["below"] & (n["open"] == 0))


def split_top(text: Column) -> Column:
    """The parts of ``text`` between commas that are in no quotes and no brackets, whatever the depth of nesting."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, piece: Column) -> Column:
        cut = (piece == ",") & (a["depth"] == 0)
        return F.struct(F.when(_opens(piece), a["depth"] + 1).when(_closes(piece), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"]).alias("depth"),
                        F.when(cut, "").otherwise(F.concat(a["part"], piece)).alias("part"),
                        F.when(cut, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), start, step, lambda a: F.concat(a["parts"], F.array(a["part"])))


def members(text: Column) -> Column:
    """The members of one bracketed list, themselves as text; an empty list has none, null what is no balanced list."""
    def cut(t: Column) -> Column:
        is_list = t.rlike(r"(?s)^(\[.*\]|\(.*\))$") & balanced(t)
        inner = F.trim(F.substring(t, 2, F.length(t) - 2))
        return F.when(is_list, F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(split_top(inner), lambda x: F.trim(x))))

    # the text stands in a lambda variable, so that nested calls compute it once
    return F.get(F.transform(F.array(F.trim(text)), cut), F.lit(0))


def tokenize(lines: DataFrame) -> DataFrame:
    """Add ts, tz_offset, event_type and params (raw strings, quotes removed, nil as null).

    The offset is kept apart and not applied. Unreadable lines keep a null ``ts``.
    """
    cut = F.split(F.regexp_replace("line", STAMP, f"$1 $2{MARK}$3{MARK}$4"), MARK, 3)
    stamp, rest = F.get("__cut", F.lit(0)), F.get("__cut", F.lit(2))
    whole = F.when(rest.endswith(","), rest.substr(F.lit(1), F.length(rest) - 1)).otherwise(rest)
    # FIELD covers two levels of brackets of a kind, as nearly all lines have, PART more levels where all brackets match; what is nested deeper still is
    # cut by counting depth, piece by piece. Lines whose brackets don't match are cut at every comma outside of whole brackets and counted by ``parse_stats``
    plain = F.regexp_extract_all(whole, F.lit(FIELD), F.lit(1))
    flat = ~(whole.contains("(") | whole.contains("["))
    deep = F.exists(F.array(nesting(whole)), lambda n: (n["depth"] > 2) & ~n["below"] & (n["open"] == 0))

    def whole_parts(parts: Column) -> Column:  # brackets that don't match are in no part, so that the parts don't make up the line
        return F.when(F.array_join(parts, ",") == whole, parts).when(deep, split_top(whole)).otherwise(plain)

    fields = F.when(flat | whole.rlike(SHALLOW), plain).otherwise(
        F.get(F.transform(F.array(F.regexp_extract_all(whole, F.lit(PART), F.lit(0))), whole_parts), F.lit(0)))

    def clean(x: Column) -> Column:
        x = F.trim(x)
        quoted = x.startswith('"') & x.endswith('"') & (F.length(x) > 1)
        return F.when(quoted, x.substr(F.lit(2), F.length(x) - 2)).when(x != "nil", x)

    read = F.size("__cut") == 3
    parsed = F.struct(
        F.when(read, F.try_to_timestamp(stamp, F.lit("M/d/yyyy H:mm:ss.SSS"))).alias("ts"),
        F.when(read, F.get("__cut", F.lit(1)).try_cast("int")).alias("tz_offset"),
        F.when(read, F.transform(fields, clean)).alias("tokens"))
    # one-element explode: later filters on ts or event_type stay above it, so a line is split once
    d = lines.withColumn("__cut", cut).withColumn("__k", F.explode(F.array(parsed)))
    n = F.size("__k.tokens")
    return d.select(
        *lines.columns, "__k.ts", "__k.tz_offset", F.get("__k.tokens", F.lit(0)).alias("event_type"),
        F.slice("__k.tokens", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("params"))


def to_long(x: Column) -> Column:
    """Integer or 0x hex, else null."""
    return F.when(x.startswith("0x"), F.conv(x.substr(F.lit(3), F.length(x)), 16, 10).try_cast("long")).otherwise(
        x.try_cast("double").cast("long"))


def to_double(x: Column) -> Column:
    return x.try_cast("double")


def to_bool(x: Column) -> Column:
    """Flags come as 1, nil, true or false; missing means false."""
    return F.coalesce(x.isin("1", "true"), F.lit(False))


def advanced_flag(tokens: DataFrame) -> DataFrame:
    """Strict mode: the header's ADVANCED_LOG_ENABLED value carried forward through each file."""
    at = F.array_position("params", "ADVANCED_LOG_ENABLED").cast("int")
    flag = F.when(F.col("event_type") == "COMBAT_LOG_VERSION", F.get("params", at) == "1")
    return carry(tokens, ["file_id"], ["line_no"], "block", advanced=upto(flag))


def prefix_size(event_type: Column) -> Column:
    size = F.lit(0)
    for prefix, n in L.PREFIX_PARAMS.items():
        size = F.when(event_type.startswith(prefix + "_"), n).otherwise(size)
    return size


EXTRA_FIELDS: dict[str, tuple[str, Callable[[Callable[[int], Column]], Column]]] = {}


def register_event_field(name: str, pattern: str, value: Callable[[Callable[[int], Column]], Column]) -> None:
    """Add a column to ``project_events`` for event types that match ``pattern``.

    ``value`` gets ``s(i)``, the i-th parameter behind prefix and unit block, and returns a Column.
    """
    EXTRA_FIELDS[name] = (pattern, value)


def project_events(tokens: DataFrame) -> DataFrame:
    """One wide typed row per readable line.

    The 19 advanced unit fields are skipped when more than 19 parameters follow the prefix of
    an affected family: no plain suffix is that long, so the line itself tells and no state
    is needed. With a column ``advanced`` (see ``advanced_flag``) the header decides instead.
    """
    t, params = F.col("event_type"), F.col("params")
    special = t.isin(SPECIAL)
    base = F.lit(L.BASE_PARAMS)
    after_prefix = F.when(special, F.lit(0)).otherwise(base + prefix_size(t))
    room = F.size(params) - after_prefix
    affected = t.rlike(L.ADVANCED_FAMILIES) & ~special & (room > L.ADVANCED_BLOCK)
    if "advanced" in tokens.columns:
        affected = affected & F.coalesce("advanced", F.lit(True))
    d = tokens.filter(F.col("ts").isNotNull() & t.isNotNull()).withColumns({
        "__o": after_prefix + F.when(affected, L.ADVANCED_BLOCK).otherwise(0), "__n": F.size(params)})
    o, left = F.col("__o"), F.col("__n") - F.col("__o")

    def p(i: int | Column) -> Column:
        return F.get(params, F.lit(i) if isinstance(i, int) else i)

    def s(i: int) -> Column:
        return p(o + i)

    absorbed = t == "SPELL_ABSORBED"
    damage = t.contains("_DAMAGE") & ~absorbed
    heal = t.contains("_HEAL") & ~absorbed & ~t.endswith("_ABSORBED")
    missed, aura = t.endswith("_MISSED"), t.contains("_AURA_")
    power = t.contains("_ENERGIZE")
    drain = t.contains("_DRAIN") | t.contains("_LEECH")
    removed = t.endswith("_INTERRUPT") | t.endswith("_DISPEL") | t.endswith("_STOLEN")
    start, end = t == "ENCOUNTER_START", t == "ENCOUNTER_END"
    run_start, run_end = t == "CHALLENGE_MODE_START", t == "CHALLENGE_MODE_END"
    unit = ~special
    spell = unit & (prefix_size(t) == 3)
    # absorbed lines: with an attacking spell the shield follows it, after a swing it comes first
    by_spell = p(8).try_cast("long").isNotNull()
    sh = F.when(by_spell, 11).otherwise(8)
    amount = (F.when(damage & (left >= 6), to_long(s(0))).when(heal & (left >= 2), to_long(s(0)))
              .when(missed, to_long(s(2))).when(power | drain, to_long(s(0))).when(absorbed, to_long(p(sh + 7))))
    critical = (F.when(damage & (left >= 9), to_bool(s(6))).when(heal & (left >= 4), to_bool(s(3)))
                .when(missed, to_bool(s(3))).otherwise(False))
    full = damage & (left >= 9)
    zero = F.lit(0).cast("long")
    keep = [c for c in ("guild_id", "file_id", "block", "line_no") if c in tokens.columns]
    return d.select(
        *keep, "ts", "tz_offset", "event_type",
        F.when(unit, p(0)).alias("source_guid"), F.when(unit, p(1)).alias("source_name"),
        F.when(unit, to_long(p(2))).alias("source_flags"), F.when(unit, to_long(p(3))).alias("source_raid_flags"),
        F.when(unit, p(4)).alias("dest_guid"), F.when(unit, p(5)).alias("dest_name"),
        F.when(unit, to_long(p(6))).alias("dest_flags"), F.when(unit, to_long(p(7))).alias("dest_raid_flags"),
        F.when(spell & ~(absorbed & ~by_spell), to_long(p(8))).alias("spell_id"),
        F.when(spell & ~(absorbed & ~by_spell), p(9)).alias("spell_name"),
        F.when(spell & ~(absorbed & ~by_spell), to_long(p(10))).alias("spell_school"),
        F.when(t.startswith("ENVIRONMENTAL_"), p(8)).alias("environmental_type"),
        F.coalesce(amount, zero).alias("amount"),
        F.coalesce(F.when(damage & (left >= 6), to_long(s(1))), zero).alias("overkill"),
        F.coalesce(F.when(heal & (left >= 2), to_long(s(1))), zero).alias("overhealing"),
        F.coalesce(F.when(damage & (left >= 6), to_long(s(3))), zero).alias("resisted"),
        F.coalesce(F.when(damage & (left >= 6), to_long(s(4))), zero).alias("blocked"),
        F.coalesce(F.when(damage & (left >= 6), to_long(s(5))).when(heal & (left >= 4), to_long(s(2))), zero).alias("absorbed"),
        critical.alias("critical"), F.when(full, to_bool(s(7))).otherwise(False).alias("glancing"),
        F.when(full, to_bool(s(8))).otherwise(False).alias("crushing"),
        F.when(aura, s(0)).when(t.endswith("_DISPEL") | t.endswith("_STOLEN"), s(3)).alias("aura_type"),
        F.when(aura & t.contains("DOSE"), F.coalesce(to_long(s(1)), F.lit(1))).alias("stacks"),
        F.when(missed, s(0)).alias("miss_type"),
        F.when(power, to_long(s(2))).when(drain, to_long(s(1))).alias("power_type"),
        F.when(removed, to_long(s(0))).when(absorbed, to_long(p(sh + 4))).alias("extra_spell_id"),
        F.when(removed, s(1)).when(absorbed, p(sh + 5)).alias("extra_spell_name"),
        F.when(absorbed, p(sh)).alias("absorber_guid"), F.when(absorbed, p(sh + 1)).alias("absorber_name"),
        F.when(start | end, to_long(p(0))).when(run_start, to_long(p(2))).alias("boss_id"),
        F.when(start | end, p(1)).when(run_start, p(0)).alias("boss_name"),
        F.when(start | end, to_long(p(2))).alias("difficulty_id"), F.when(start | end, to_long(p(3))).alias("group_size"),
        F.when(start, to_long(p(4))).when(run_start, to_long(p(1))).when(run_end, to_long(p(0))).alias("instance_id"),
        F.when(run_start, to_long(p(3))).when(run_end, to_long(p(2))).alias("keystone_level"),
        F.when(run_start, long_list(p(4))).alias("affixes"),
        F.when(end, to_bool(p(4))).when(run_end, to_bool(p(1))).alias("success"),
        F.when(end, to_long(p(5))).when(run_end, to_long(p(3))).alias("logged_duration_ms"),
        *[F.when(t.rlike(pattern), value(s)).alias(name) for name, (pattern, value) in EXTRA_FIELDS.items()])


# --- quality -------------------------------------------------------------------------------------

def parse_errors(tokens: DataFrame) -> DataFrame:
    """Lines without a readable stamp or event name, for a quarantine table."""
    return tokens.filter(F.col("ts").isNull() | F.col("event_type").isNull())


def parse_stats(tokens: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lines, errors, readable lines with a list that doesn't close or was never opened, and the share of readable lines."""
    bad = F.col("ts").isNull() | F.col("event_type").isNull()
    torn = F.exists("params", lambda x: F.coalesce(x.rlike(r"^[\[(]|^[^\[(]*[\])]$") & ~balanced(x), F.lit(False)))
    d = tokens.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(bad).alias("errors"), F.count_if(~bad & torn).alias("unbalanced"))
    return d.withColumn("success_rate", (F.col("lines") - F.col("errors")) / F.greatest(F.col("lines"), F.lit(1)))


def least_params(event_type: Column) -> Column:
    """Smallest parameter count of the event's family; null for unknown events."""
    table = F.create_map(*[F.lit(x) for pair in L.SPECIAL_PARAMS.items() for x in pair])
    prefix = C.any_of(event_type.startswith(x + "_") for x in L.PREFIX_PARAMS)
    suffix = F.lit(None).cast("int")
    for name, n in reversed(L.SUFFIX_PARAMS):
        suffix = F.when(event_type.contains(name), n).otherwise(suffix)
    # SPELL_ABSORBED: shield owner, shield spell, amount; a swing carries no attacking spell
    family = (F.when(event_type == "SPELL_ABSORBED", L.BASE_PARAMS + 8)
              .when(event_type.isin(L.BASE_ONLY), L.BASE_PARAMS)
              .when(prefix | suffix.isNotNull(), L.BASE_PARAMS + prefix_size(event_type) + F.coalesce(suffix, F.lit(0))))
    return F.coalesce(F.try_element_at(table, event_type), family)


def validate_events(tokens: DataFrame) -> DataFrame:
    """Add valid and issue; unknown event types pass with a warning."""
    least = least_params(F.col("event_type"))
    n = F.size("params")
    issue = (F.when(least.isNull(), F.concat(F.lit("unknown event type: "), F.col("event_type")))
             .when(n < least, F.format_string("expected at least %d parameters, got %d", least, n)))
    return tokens.withColumn("valid", F.coalesce(n >= least, F.lit(True))).withColumn("issue", issue)


# --- nested parameters -------------------------------------------------------------------------------

def long_list(text: Column) -> Column:
    """Integers of a flat ``[..]`` or ``(..)``."""
    return F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)).cast("array<bigint>")


def tuples(text: Column, fields: Sequence[str]) -> Column:
    """Structs of integers from ``[(a,b,c),(..)]``; tuples that are too short are left out."""
    body = ",".join([r"(-?\d+)"] * len(fields))
    pattern = rf"\({body}(?:,[^()]*)?\)"
    # a pass over the text for each group, and none over the single tuples
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(fields))]
    return F.arrays_zip(*found).cast(f"array<struct<{','.join(f'`{f}`:bigint' for f in fields)}>>")


_ITEM = r"\((\d+),(\d+),\(([^()]*)\),\(([^()]*)\),\(([^()]*)\)[^()]*\)"


def item_list(text: Column) -> Column:
    """Structs item_id, ilvl, gems, enchants, bonus_ids from the equipment array."""
    # (id,level,(gems),(enchants),(bonus)..): what has been found holds no other parentheses, so it is taken apart at the closing ones
    found = F.transform(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0)), lambda m: F.split(m, r"\)"))

    def numbers(x: Column, i: int) -> Column:
        return long_list(F.substring_index(F.get(x, F.lit(i)), "(", -1))

    def first(x: Column, i: int) -> Column:
        return F.substring_index(F.substring_index(F.get(x, F.lit(0)), ",", i), "(" if i == 1 else ",", -1).cast("long")

    return F.transform(found, lambda x: F.struct(
        first(x, 1).alias("item_id"), first(x, 2).alias("ilvl"), numbers(x, 0).alias("gems"), numbers(x, 1).alias("enchants"), numbers(x, 2).alias("bonus_ids")))


def aura_list(text: Column) -> Column:
    """Structs source, spell, stacks from a flat array read in threes."""
    def read(flat: Column) -> Column:
        n = F.floor(F.size(flat) / 3).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            F.get(flat, i * 3).alias("source"), F.coalesce(F.get(flat, i * 3 + 1).try_cast("long"), F.lit(0)).alias("spell"),
            F.coalesce(F.get(flat, i * 3 + 2).try_cast("long"), F.lit(1)).alias("stacks")))

    # the parts stand in a lambda variable, so that a text is cut once and not for every aura
    return F.get(F.transform(F.array(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ",")), read), F.lit(0))


STATS = ["faction", "strength", "agility", "stamina", "intelligence", "dodge", "parry", "block", "crit_melee", "crit_ranged",
         "crit_spell", "speed", "lifesteal", "haste_melee", "haste_ranged", "haste_spell", "avoidance", "mastery",
         "versatility_damage", "versatility_healing", "versatility_taken", "armor", "spec_id"]
WHOLE = {"faction", "strength", "agility", "stamina", "intelligence", "armor", "spec_id"}


def combatant_info(tokens: DataFrame) -> DataFrame:
    """Stats, talents, pvp talents, items and auras of COMBATANT_INFO lines."""
    d = tokens.filter((F.col("event_type") == "COMBATANT_INFO") & (F.size("params") >= 24))

    def stat(i: int, name: str) -> Column:
        x = F.coalesce(F.get("params", F.lit(i + 1)).try_cast("double"), F.lit(0.0))
        return (x.cast("long") if name in WHOLE else x).alias(name)

    keep = [c for c in ("guild_id", "file_id", "block", "line_no") if c in tokens.columns]
    # plain columns are compiled, and Spark parses only those that are asked for. Several uses of a list share its parsing, except that a filter on it,
    # also the one that exploding it implies, parses it again: put it into a one-element explode first, as the snapshots do
    return d.select(
        *keep, "ts", F.get("params", F.lit(0)).alias("player_guid"), *[stat(i, n) for i, n in enumerate(STATS)],
        tuples(F.get("params", F.lit(24)), ["id", "spell", "rank"]).alias("talents"),
        long_list(F.get("params", F.lit(25))).alias("pvp_talents"),
        item_list(F.get("params", F.lit(26))).alias("items"), aura_list(F.get("params", F.lit(27))).alias("auras"))


# --- gear, talents, consumables -------------------------------------------------------------------------

def gear_snapshots(ci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per worn item of the first 18 slots with the snapshot's weighted item level."""
    extra = F.concat("i.gems", "i.bonus_ids")
    small = F.filter(extra, lambda x: x < 100)
    gem = lambda x: (x > 100000) & (x < 200000)
    weight = F.when(F.col("slot").isin(L.COSMETIC_SLOTS), 0.0).when(F.col("slot") == L.MAIN_HAND, 2.0).otherwise(1.0)
    # at most 18 items per snapshot, so the average is taken inside the row
    ranked = F.transform("items", lambda x, pos: F.struct((pos + 1).alias("slot"), x.alias("i")))
    worn = F.filter(ranked, lambda x: (x["slot"] <= 18) & (x["i"]["item_id"] > 0) & x["i"]["ilvl"].between(1, 1000))
    def share(x):
        w = F.when(x["slot"].isin(L.COSMETIC_SLOTS), 0.0).when(x["slot"] == L.MAIN_HAND, 2.0).otherwise(1.0)
        return w
    top = F.aggregate("__worn", F.lit(0.0), lambda a, x: a + x["i"]["ilvl"] * share(x))
    bottom = F.aggregate("__worn", F.lit(0.0), lambda a, x: a + share(x))
    counted = F.size(F.filter("__worn", lambda x: ~x["slot"].isin(L.COSMETIC_SLOTS)))
    d = ci.select(*keys, F.explode(F.array(worn)).alias("__worn")).withColumns({
        "average_item_level": F.bround(C.ratio(top, bottom), 2), "total_items": counted})
    d = d.select(*keys, "average_item_level", "total_items", F.explode("__worn").alias("w")).select(*keys, "average_item_level", "total_items", "w.*")
    return d.select(
        *keys, "slot", C.slot_name(F.col("slot")).alias("slot_name"), F.col("i.item_id").alias("item_id"), F.col("i.ilvl").alias("item_level"),
        weight.alias("weight"), F.coalesce(F.get("i.enchants", F.lit(0)), F.lit(0)).alias("enchant_id"),
        F.slice(F.filter(extra, gem), 1, 4).alias("gem_ids"), F.coalesce(F.try_element_at(small, F.lit(-1)), F.lit(0)).alias("upgrade_level"),
        F.filter(extra, lambda x: ~gem(x) & (x >= 100)).alias("bonus_ids"), "average_item_level", "total_items")


def talent_snapshots(ci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per chosen talent with tier, column, the loadout text and the total."""
    chosen = F.filter(F.transform("talents", lambda x, pos: F.struct(pos.alias("pos"), x.alias("t"))), lambda x: x["t"]["spell"] != 0)
    d = ci.select(*keys, F.explode(F.array(chosen)).alias("__t")).withColumns({
        "loadout": F.array_join(F.transform("__t", lambda x: x["t"]["spell"].cast("string")), " "), "total_talents": F.size("__t")})
    return d.select(*keys, "loadout", "total_talents", F.explode("__t").alias("x")).select(
        *keys, (F.col("x.pos") + 1).alias("slot"), F.col("x.t.spell").alias("spell"), F.col("x.t.rank").alias("rank"),
        (F.floor(F.col("x.pos") / 3) + 1).alias("tier"), (F.col("x.pos") % 3 + 1).alias("column"), "loadout", "total_talents")


def has_enchant(item: Column) -> Column:
    return F.exists(item["enchants"], lambda e: e != 0)


def consumables(ci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flask, food, weapon enchants, gems, mean item level, enchant check and build text."""
    def aura(ids: Sequence[int]) -> Column:
        return F.get(F.filter("auras", lambda a: a["spell"].isin(list(ids))), F.lit(0))["spell"]

    weapons = F.flatten(F.transform(F.slice("items", 1, 2), lambda i: F.filter(i["enchants"], lambda e: e != 0)))
    gems = F.aggregate("items", F.lit(0), lambda a, i: a + F.size(F.filter(i["gems"], lambda g: g != 0)))
    levels = F.filter(F.transform("items", lambda i: i["ilvl"]), lambda x: x > 0)
    mean = F.when(F.size(levels) > 0, F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(levels)).otherwise(0.0)
    first = F.slice("items", 1, 8)
    whole = (F.size(first) > 0) & F.forall(F.filter(first, lambda i: i["item_id"] > 0), has_enchant)
    build = F.array_join(F.transform(F.slice("talents", 1, 10), lambda t: t["id"].cast("string")), ",")
    flask, food = aura(L.FLASKS), aura(L.FOODS)
    return ci.select(
        *keys, flask.alias("flask"), food.alias("food"), weapons.alias("weapon_enchants"), gems.alias("total_gems"),
        mean.alias("average_item_level"), (flask.isNotNull() | food.isNotNull()).alias("has_consumables"),
        whole.alias("fully_enchanted"), build.alias("build"))


def gear_advice(gear: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for slots far below the average and for enchantable slots without enchant."""
    low = F.col("item_level") < F.col("average_item_level") - 10
    bare = F.col("slot_name").isin(L.ENCHANTABLE) & (F.col("enchant_id") == 0)
    kinds = F.filter(F.array(F.when(low, "upgrade"), F.when(bare, "enchant")), lambda x: x.isNotNull())
    return gear.filter(F.col("average_item_level") > 0).select(
        *keys, "slot_name", "item_level", F.floor("average_item_level").alias("recommended_ilvl"), F.explode(kinds).alias("advice"))


def talent_advice(ci: DataFrame, keys: Sequence[str], encounter_type: Column) -> DataFrame:
    spells = F.transform("talents", lambda t: t["spell"])
    few = F.size(F.filter(spells, lambda s: s != 0)) < 10

    def lacks(ids: Sequence[int]) -> Column:
        return ~F.arrays_overlap(spells, F.array(*[F.lit(i).cast("long") for i in ids]))

    kinds = F.filter(F.array(
        F.when(few, "missing_talents"), F.when((encounter_type == "raid") & lacks(L.DEFENSIVE_TALENTS), "defensive_talents"),
        F.when((encounter_type == "mythic_plus") & lacks(L.AOE_TALENTS), "aoe_talents")), lambda x: x.isNotNull())
    return ci.select(*keys, F.explode(kinds).alias("advice"))
