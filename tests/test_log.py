"""Hand-written log lines and the rows they must give."""

import pytest
from pyspark.sql import functions as F

from fraylens.operators import segments
from fraylens.sources import log

UNITS = "Player-1-A,\"Ann-Realm-EU\",0x512,0x0,Creature-0-9,\"Boss, the \\\"Big\\\"\",0x10a48,0x0"
ADV = ",".join(str(i) for i in range(19))
LINES = {
    "header": '9/15/2025 21:30:00.000-4  COMBAT_LOG_VERSION,22,ADVANCED_LOG_ENABLED,1,BUILD_VERSION,11.2.0,PROJECT_ID,1',
    "damage": f'9/15/2025 21:30:01.123-4  SPELL_DAMAGE,{UNITS},133,"Fire, Ball",0x4,5000,-1,4,1,2,3,1,nil,nil',
    "advanced": f'9/15/2025 21:30:01.200-4  SPELL_DAMAGE,{UNITS},133,"Fire, Ball",0x4,{ADV},6000,10,4,0,0,0,nil,nil,nil',
    "short": f'9/15/2025 21:30:01.300-4  SWING_DAMAGE,{UNITS},700,0,1,0,0,9',
    "heal": f'9/15/2025 21:30:02.000-4  SPELL_HEAL,{UNITS},774,"Bloom",0x8,900,100,7,1',
    "heal_advanced": f'9/15/2025 21:30:02.100-4  SPELL_PERIODIC_HEAL,{UNITS},774,"Bloom",0x8,{ADV},300,50,0,nil',
    "heal_short": f'9/15/2025 21:30:02.200-4  SPELL_HEAL,{UNITS},774,"Bloom",0x8,40,5',
    "missed": f'9/15/2025 21:30:02.300-4  SPELL_MISSED,{UNITS},133,"Fire",0x4,ABSORB,nil,77,1',
    "absorb_swing": f'9/15/2025 21:30:03.000-4  SPELL_ABSORBED,{UNITS},Player-2-B,"Bea",0x512,0x0,17,"Shield",0x2,450,nil',
    "absorb_spell": f'9/15/2025 21:30:03.100-4  SPELL_ABSORBED,{UNITS},133,"Fire",0x4,Player-2-B,"Bea",0x512,0x0,17,"Shield",0x2,460,nil',
    "energize": f'9/15/2025 21:30:03.200-4  SPELL_ENERGIZE,{UNITS},1,"Run",0x1,25,5,3,100',
    "interrupt": f'9/15/2025 21:30:03.300-4  SPELL_INTERRUPT,{UNITS},2139,"Stop",0x40,686,"Bolt",0x20',
    "dose": f'9/15/2025 21:30:03.400-4  SPELL_AURA_APPLIED_DOSE,{UNITS},5,"Stack",0x1,DEBUFF,4',
    "fall": '9/15/2025 21:30:04.000+11  ENVIRONMENTAL_DAMAGE,nil,nil,0x0,0x0,Player-1-A,"Ann",0x512,0x0,Falling,321,0,1,0,0,0,nil,nil,nil',
    "start": '9/15/2025 21:30:05.000-4  ENCOUNTER_START,2902,"Ulgrax the Devourer",16,20,2657',
    "end": '9/15/2025 21:33:05.000-4  ENCOUNTER_END,2902,"Ulgrax the Devourer",16,20,1,180000',
    "run": '9/15/2025 21:40:00.000-4  CHALLENGE_MODE_START,"The Stonevault",2652,501,12,[9,10,147]',
    "run_end": '9/15/2025 22:10:00.000-4  CHALLENGE_MODE_END,2652,1,12,1800000,33.5,280.1',
    "bad_date": '99/99/2025 21:30:05.000-4  UNIT_DIED,nil',
    "bad": 'not a log line',
}


@pytest.fixture(scope="module")
def events(spark):
    lines = spark.createDataFrame([(1, "f", 0, i, t) for i, t in enumerate(LINES.values())],
                                  "guild_id long, file_id string, block long, line_no long, line string")
    tokens = log.tokenize(lines)
    rows = {r.line_no: r for r in log.project_events(tokens).collect()}
    return {name: rows.get(i) for i, name in enumerate(LINES)}, tokens


@pytest.mark.parametrize("name, want", [
    ("damage", dict(amount=5000, overkill=-1, resisted=1, blocked=2, absorbed=3, critical=True, glancing=False, spell_id=133,
                    spell_name="Fire, Ball", source_flags=0x512, dest_flags=0x10A48, tz_offset=-4)),
    ("advanced", dict(amount=6000, overkill=10, critical=False, spell_id=133)),
    ("short", dict(amount=700, absorbed=9, critical=False, spell_id=None)),
    ("heal", dict(amount=900, overhealing=100, absorbed=7, critical=True)),
    ("heal_advanced", dict(amount=300, overhealing=50, critical=False)),
    ("heal_short", dict(amount=40, overhealing=5, absorbed=0)),
    ("missed", dict(miss_type="ABSORB", amount=77, critical=True)),
    ("absorb_swing", dict(absorber_guid="Player-2-B", amount=450, extra_spell_id=17, spell_id=None)),
    ("absorb_spell", dict(absorber_guid="Player-2-B", amount=460, extra_spell_name="Shield", spell_id=133)),
    ("energize", dict(amount=25, power_type=3)),
    ("interrupt", dict(extra_spell_id=686, extra_spell_name="Bolt", spell_id=2139)),
    ("dose", dict(aura_type="DEBUFF", stacks=4)),
    ("fall", dict(environmental_type="Falling", amount=321, source_guid=None, tz_offset=11)),
    ("start", dict(boss_id=2902, boss_name="Ulgrax the Devourer", difficulty_id=16, group_size=20, instance_id=2657)),
    ("end", dict(success=True, logged_duration_ms=180000)),
    ("run", dict(boss_name="The Stonevault", keystone_level=12, boss_id=501, affixes=[9, 10, 147])),
    ("run_end", dict(success=True, keystone_level=12, logged_duration_ms=1800000)),
])
def test_projection(events, name, want):
    row = events[0][name].asDict()
    assert {k: row[k] for k in want} == want


def test_names_keep_commas_and_quotes(events):
    assert events[0]["damage"].dest_name == 'Boss, the \\"Big\\"'


def test_errors_and_stats(events):
    _rows, tokens = events
    assert {r.line_no for r in log.parse_errors(tokens).collect()} == {len(LINES) - 2, len(LINES) - 1}
    s = log.parse_stats(tokens).first()
    assert (s.lines, s.errors) == (len(LINES), 2)


def test_header_flag_can_decide(events):
    _rows, tokens = events
    flagged = log.project_events(log.advanced_flag(tokens.filter(F.col("ts").isNotNull())))
    assert {r.line_no: r.amount for r in flagged.collect()}[2] == 6000


def test_read_log_skips_blank_and_comments(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(("# note\n\n  \n" + LINES["heal"] + "  \n").encode() + b"\xff\xfe broken\n")
    got = log.read_log(spark, str(tmp_path), guild_id=-5).collect()
    assert [r.guild_id for r in got] == [1, 1] and got[0].line == LINES["heal"]


def boundary(spark, data):
    return spark.createDataFrame(
        [(1, i * 10, i, kind, boss, name, ok) for i, (kind, boss, name, ok) in enumerate(data)],
        "guild_id long, s long, line_no long, event_type string, boss_id long, boss_name string, success boolean").withColumn(
        "ts", F.timestamp_seconds("s"))


def test_run_with_two_bosses(spark):
    b = boundary(spark, [
        ("ENCOUNTER_START", 7, "Raid", None), ("ENCOUNTER_END", 8, "Other", True), ("ENCOUNTER_END", 7, "Raid", False),
        ("CHALLENGE_MODE_START", 501, "Vault", None), ("ENCOUNTER_START", 1, "One", None), ("ENCOUNTER_END", 1, "One", True),
        ("ENCOUNTER_START", 2, "Two", None), ("ENCOUNTER_END", 2, "Two", True), ("CHALLENGE_MODE_END", None, None, True),
        ("ENCOUNTER_START", 7, "Raid", None)])
    fights = [(r.fight_name, r.fight_type, r.start_ts.second + 60 * r.start_ts.minute, r.end_ts and r.end_ts.second + 60 * r.end_ts.minute, r.success)
              for r in segments.unified_fights(b, ["guild_id"]).orderBy("start_ts", "part").collect()]
    assert fights == [
        ("Raid - Pull 1", "normal", 0, 20, False), ("Vault - Trash (Entrance)", "trash", 30, 40, None), ("Boss: One", "boss", 40, 50, True),
        ("Vault - Trash (2)", "trash", 50, 60, None), ("Boss: Two", "boss", 60, 70, True), ("Vault - Trash (3)", "trash", 70, 80, True),
        ("Raid - Pull 2", "normal", 90, None, None)]
    enc = segments.unified_encounters(b, ["guild_id"]).orderBy("start_ts").collect()
    assert [(e.encounter_type, e.pull_number, e.success) for e in enc] == [("raid", 1, False), ("mythic_plus", 0, True), ("raid", 2, None)]


def test_registered_event_field(events):
    _rows, tokens = events
    log.register_event_field("max_power", "_ENERGIZE$", lambda s: log.to_long(s(3)))
    try:
        got = {r.line_no: r.max_power for r in log.project_events(tokens).collect()}
    finally:
        log.EXTRA_FIELDS.clear()
    assert got[list(LINES).index("energize")] == 100 and got[list(LINES).index("heal")] is None


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Physical lines, at every ingest and for any cut of the files; blank and comment lines count."""
    texts = {}
    for k in range(3):
        lines = [("# note" if i % 11 == 0 else "" if i % 13 == 0 else f"{k}:{i} " + "x" * (i * 37 % 200)) for i in range(1, 900 * (k + 1))]
        texts[k] = lines
        (tmp_path / f"log{k}.txt").write_text("\n".join(lines) + "\n")
    want = {(k, i + 1, line.rstrip(" ")) for k, lines in texts.items() for i, line in enumerate(lines) if line.strip() and not line.startswith("#")}
    key, splits = "spark.sql.files.maxPartitionBytes", set()
    before = spark.conf.get(key)
    try:
        for size in ("128m", "64k", "7k", "1k"):
            spark.conf.set(key, size)
            rows = log.read_log(spark, str(tmp_path)).collect()
            assert {(int(r.file_id[-5]), r.line_no, r.line) for r in rows} == want and len(rows) == len(want)
            splits.add(len({(r.file_id, r.block) for r in rows}))
            by_file = sorted((r.file_id, r.line_no, r.block) for r in rows)
            assert all(a[2] <= b[2] for a, b in zip(by_file, by_file[1:]) if a[0] == b[0])
    finally:
        spark.conf.set(key, before)
    assert min(splits) == 3 and max(splits) > 30


def test_many_splits_are_joined(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 500)))
    monkeypatch.setattr(log, "OFFSETS_SENT", 0)
    assert {(r.line_no, r.line) for r in log.read_log(spark, str(tmp_path)).collect()} == {(i, str(i)) for i in range(1, 500)}


def test_another_cut_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i} {'y' * 50}\n" for i in range(1, 500)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1k")
        lines = log.read_log(spark, str(tmp_path))
        spark.conf.set(key, "128m")
        with pytest.raises(Exception, match="changed while"):
            lines.collect()
    finally:
        spark.conf.set(key, before)


def plain_split(text):
    """Top-level parts, by a loop over characters."""
    parts, now, depth, quoted, i = [], "", 0, False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            now, i = now + text[i:i + 2], i + 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[(":
            depth += 1
        elif not quoted and c in "])":
            depth = max(0, depth - 1)
        if c == "," and not quoted and depth == 0:
            parts, now = parts + [now], ""
        else:
            now += c
        i += 1
    return parts + [now]


def test_nesting_of_any_depth(spark):
    deep = "x" if True else ""
    for i in range(7):
        deep = f"[({i},{deep}),\"q, ]({i}\"]"
    texts = [deep, f"1,{deep},2", "", ",", "a,,b", "[]", "()", "[(1,2),(3,(4,[5,(6)]))],7", 'x,"a\\"b, [",(1,(2,(3)))', "(((((((1,2),3),4),5),6),7),8),9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", log.split_top(F.col("t")).alias("parts"), log.members(F.col("t")).alias("members")).collect()
    for r in rows:
        assert r["parts"] == (plain_split(r["t"]) if r["t"] else [""])
        whole = r["t"][:1] in "[(" and r["t"][-1:] in "])" and len(plain_split(r["t"])) == 1 and r["t"]
        assert r["members"] == (None if not whole else [] if len(r["t"]) == 2 else plain_split(r["t"][1:-1]))
    line = '9/15/2025 21:30:00.000-4  NESTED,1,' + deep + ',"z",(1,(2,(3)))'
    torn = '9/15/2025 21:30:00.000-4  NESTED,1,[(1,2),(3,4'
    d = log.tokenize(spark.createDataFrame([("f", 1, line), ("f", 2, torn), ("f", 3, "9/15/2025 21:30:00.000-4  OK,[(1,2)],\"a (b\""), ("f", 4, "junk")], "file_id string, line_no long, line string"))
    got = {r["line_no"]: r["params"] for r in d.collect()}
    assert got[1] == ["1", deep, "z", "(1,(2,(3)))"] and got[3] == ["[(1,2)]", "a (b"]
    stats = log.parse_stats(d).first()
    assert (stats["lines"], stats["errors"], stats["unbalanced"]) == (4, 1, 1)
