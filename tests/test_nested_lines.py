"""Nested parameters: cut as by counting depth piece by piece, lists read as match by match, and long lines in time that grows with their length."""

import random
import time

from pyspark.sql import functions as F

from fraylens.sources import log

HEAD = "1/2/2024 03:04:05.678+1  "


def fields_by_depth(whole):
    """Parts of a line as its definition has them: by depth where brackets close and are nested deeper than two, else by pattern."""
    deep = F.exists(F.array(log.nesting(whole)), lambda n: (n["depth"] > 2) & ~n["below"] & (n["open"] == 0))
    return F.when(deep, log.split_top(whole)).otherwise(F.regexp_extract_all(whole, F.lit(log.FIELD), F.lit(1)))


def odd_texts():
    rng = random.Random(5)
    texts = ["A,[(1,2,(3,50),(1),(2,3))],x", "[(1,2,(3)],4)", ",A,((([1]))),", 'A,"a)b",[(1,("]",2))],,(', 'A,["a]b",1],(2)', "A,((((((1,2))))),3),[4]", "A,[((1),2)", '"', "A,((()))"]
    for _ in range(1500):
        texts.append("".join(rng.choice('a1,,"\\[]() ') for _ in range(rng.randrange(1, 24))))
    for _ in range(1500):  # nested and closed, at times in the other kind, with one more mark at times
        text = "a"
        for _ in range(rng.randrange(1, 7)):
            a, b = rng.choice(["()", "[]", "()", "[]", "[)"])
            text = rng.choice([f"{a}{text}{b}", f"{text},{a}{text}{b}", f'{a}{text},"{rng.choice("x)],")}",1{b},y'])
        at = rng.randrange(len(text))
        texts.append(text[:at] + rng.choice(["", "", ",", "(", '"']) + text[at:])
    return texts


def test_parts_are_those_by_depth(spark):
    lines = spark.createDataFrame([(i, HEAD + t) for i, t in enumerate(odd_texts())], "line_no long, line string").localCheckpoint()
    whole = F.substring("line", len(HEAD) + 1, 100_000)
    whole = F.when(whole.endswith(","), whole.substr(F.lit(1), F.length(whole) - 1)).otherwise(whole)

    def clean(x):
        x = F.trim(x)
        return F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), x.substr(F.lit(2), F.length(x) - 2)).when(x != "nil", x)
    want = {r.line_no: r.f for r in lines.select("line_no", F.transform(fields_by_depth(whole), clean).alias("f")).collect()}
    got = {r.line_no: r for r in log.tokenize(lines).collect()}
    for r in lines.collect():
        g = got[r.line_no]
        assert [g.event_type, *g.params] == want[r.line_no], r.line


def test_lists_are_those_by_match(spark):
    rng = random.Random(6)
    item = lambda: f"({rng.randrange(9)},{rng.randrange(700)},({rng.choice(['', '12,50', 'a1-2', '-3'])}),({rng.choice(['', '7'])}),({rng.choice(['1,2,3', ',,4', ''])}){rng.choice(['', ',x', ')'])})"
    texts = [None, "", "[]"] + ["[" + ",".join(rng.choice([item(), "(1,2,3)", "(1,-2,3,4 x)", "(1,2)", "p-1,22,3", "(null,1,2)", ",", "]"]) for _ in range(rng.randrange(6))) + "]" for _ in range(800)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").localCheckpoint()
    t, numbers = F.col("t"), r"-?\d+"

    def longs(x):
        return F.transform(F.regexp_extract_all(x, F.lit(numbers), F.lit(0)), lambda n: n.cast("long"))

    def group(m, pattern, i):
        return F.regexp_extract(m, pattern, i)
    three, flat = r"\((-?\d+),(-?\d+),(-?\d+)(?:,[^()]*)?\)", F.split(F.regexp_replace(t, r"^\[|\]$", ""), ",")
    tuples = F.transform(F.regexp_extract_all(t, F.lit(three), F.lit(0)), lambda m: F.struct(*[group(m, three, i + 1).cast("long").alias(n) for i, n in enumerate("abc")]))
    items = F.transform(F.regexp_extract_all(t, F.lit(log._ITEM), F.lit(0)), lambda m: F.struct(
        group(m, log._ITEM, 1).cast("long").alias("item_id"), group(m, log._ITEM, 2).cast("long").alias("ilvl"), longs(group(m, log._ITEM, 3)).alias("gems"),
        longs(group(m, log._ITEM, 4)).alias("enchants"), longs(group(m, log._ITEM, 5)).alias("bonus_ids")))
    n = F.floor(F.size(flat) / 3).cast("int")
    auras = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.get(flat, i * 3).alias("source"), F.coalesce(F.get(flat, i * 3 + 1).try_cast("long"), F.lit(0)).alias("spell"),
        F.coalesce(F.get(flat, i * 3 + 2).try_cast("long"), F.lit(1)).alias("stacks")))
    for new, old in ((log.tuples(t, ["a", "b", "c"]), tuples), (log.item_list(t), items), (log.aura_list(t), auras), (log.long_list(t), longs(t))):
        got, want = d.select(new.alias("x"), "t").collect(), d.select(old.alias("x"), "t").collect()
        assert got == want
        assert sum(bool(r.x) for r in want) > 100


def test_an_aura_does_not_cut_the_text_again(spark):
    plan = spark.range(1).select(log.aura_list(F.col("id").cast("string")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_long_line(spark):
    """20,000 talents, items and auras: cut piece by piece, or for each aura again, one line would take minutes."""
    n = 20_000
    talents = ",".join(f"({i},{i * 2},1)" for i in range(n))
    items = ",".join(f"({i + 1},600,({i},50),(1),(5,{i}))" for i in range(n))
    auras = ",".join(f"Player-{i},{i},2" for i in range(n))
    line = f"{HEAD}COMBATANT_INFO,Player-1,{','.join(['3'] * 23)},[{talents}],(1,0,22,0),[{items}],[{auras}]"
    d = spark.createDataFrame([(0, line)], "line_no long, line string").localCheckpoint()
    began = time.monotonic()
    r = log.combatant_info(log.tokenize(d)).first()
    took = time.monotonic() - began
    assert [len(r.talents), len(r.items), len(r.auras), r.pvp_talents] == [n, n, n, [1, 0, 22, 0]]
    assert r.items[-1].asDict() == {"item_id": n, "ilvl": 600, "gems": [n - 1, 50], "enchants": [1], "bonus_ids": [5, n - 1]}
    assert r.talents[-1].asDict() == {"id": n - 1, "spell": 2 * n - 2, "rank": 1} and r.auras[-1].asDict() == {"source": f"Player-{n - 1}", "spell": n - 1, "stacks": 2}
    assert took < 20


def test_snapshots_read_a_list_once(spark):
    """Exploding a list implies filters on it, which must not read its text again."""
    ci = log.combatant_info(log.tokenize(spark.createDataFrame([(0, HEAD + "X")], "line_no long, line string")))
    for out, pattern, times in ((log.talent_snapshots(ci, ["line_no"]), r"(-?\d+),(-?\d+)", 3), (log.gear_snapshots(ci, ["line_no"]), log._ITEM, 1)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count(pattern) == times
