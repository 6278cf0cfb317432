"""Search, listing, set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fraylens.operators import filters, listing, search
from fraylens.plans.catalog import Tables, query
from fraylens.plans.joins import LOC, metric_rows
from fraylens.plans.rows import ENC, encounters
from fraylens.plans.standins import combat_events, us

HITS = "(length(lower({f})) - length(replace(lower({f}), '{t}', ''))) / {n}"


def hit_sql(field: str, term: str) -> str:
    return f"CAST((length(lower({field})) - length(replace(lower({field}), '{term}', ''))) // {len(term)} AS BIGINT)"


SCORE = f"({hit_sql('text', 'the')} * 1.0 + {hit_sql('text', 'with')} * 1.0 + {hit_sql('source', 'the')} * 3.0 + {hit_sql('source', 'with')} * 3.0)"


@query("q01_text_search", f"""WITH s AS (SELECT doc_id, ({SCORE})::DOUBLE AS score, text FROM documents)
SELECT doc_id, score, (SELECT count(*) FROM s WHERE score > 0) AS total_count, sha256(regexp_replace(text, '(the|with)', '<mark>\\1</mark>', 'gi')) AS highlight_hash
FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def _(t: Tables):
    found = search.text_search(t.documents, "the with", {"text": 1.0, "source": 3.0}, "doc_id", 50, marked="text")
    return found.select("doc_id", "score", "total_count", F.sha2("highlight", 256).alias("highlight_hash"))


@query("q01_part_search", f"""WITH s AS (SELECT p_partkey, p_name, ({hit_sql('p_name', 'red')} * 2.0 + {hit_sql('p_type', 'red')})::DOUBLE AS score FROM part)
SELECT p_partkey, score, regexp_replace(p_name, '(red)', '<mark>\\1</mark>', 'gi') AS highlight, (SELECT count(*) FROM s WHERE score > 0) AS total_count FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20 OFFSET 20""")
def _(t: Tables):
    found = search.text_search(t.part, "red", {"p_name": 2.0, "p_type": 1.0}, "p_partkey", 20, 20, marked="p_name")
    return found.select("p_partkey", "score", "highlight", "total_count")


TREE = {"and": [{"field": "p_type", "operator": "in", "value": ["economy", "SMALL"], "case_sensitive": False},
                {"or": [{"field": "p_size", "operator": "gt", "value": 40}, {"field": "p_name", "operator": "contains", "value": "WIDGET", "case_sensitive": False}]},
                {"not": {"field": "p_brand", "operator": "eq", "value": "Brand#2"}}]}
TREE_SQL = "lower(p_type) IN ('economy', 'small') AND (p_size > 40 OR lower(p_name) LIKE '%widget%') AND NOT p_brand = 'Brand#2'"


@query("q02_boolean_search", f"SELECT p_partkey FROM part WHERE {TREE_SQL}")
def _(t: Tables):
    return t.part.filter(filters.tree(TREE, t.part.columns)).select("p_partkey")


@query("q03_fuzzy_search", """SELECT p_partkey, levenshtein(lower(p_name), 'red wigdet') AS edits, round(1 - levenshtein(lower(p_name), 'red wigdet') / greatest(length(p_name), 10), 6) AS similarity
FROM part WHERE levenshtein(lower(p_name), 'red wigdet') <= 3 AND 1 - levenshtein(lower(p_name), 'red wigdet') / greatest(length(p_name), 10) >= 0.6""")
def _(t: Tables):
    f = search.fuzzy_search(t.part, "p_name", "red wigdet", 0.6, 3)
    return f.select("p_partkey", F.col("edits").cast("long").alias("edits"), F.round("similarity", 6).alias("similarity"))


@query("q03_phonetic_search", "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%'")
def _(t: Tables):
    return search.phonetic_search(t.part, "p_name", "wydgette").select("p_partkey")


WORDS = "w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term, doc_id FROM documents)"


@query("q04_suggest", f"WITH {WORDS} SELECT term, count(*) AS n FROM w WHERE term LIKE 'th%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t: Tables):
    return search.suggest(t.documents, "text", "th", 10)


@query("q04_suggest_when_few", "WITH w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS term FROM part) SELECT term, count(*) AS n FROM w WHERE term LIKE 'wi%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t: Tables):
    hits = t.part.filter(F.col("p_name").contains("wizzard"))
    return search.suggest_when_few(hits, t.part, "p_name", "wizzard")


@query("q05_facets", """WITH h AS (SELECT * FROM part WHERE p_name LIKE '%red%') SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM h GROUP BY 2
UNION ALL SELECT 'p_type', p_type, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM h GROUP BY 2""")
def _(t: Tables):
    return search.facets(t.part.filter(F.col("p_name").contains("red")), ["p_brand", "p_type", "p_size"])


@query("q06_popular_terms", f"""WITH {WORDS}, c AS (SELECT term, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS now, count(*) FILTER (doc_id % 3 <> 0) AS "then" FROM w GROUP BY 1)
SELECT term, n, now, "then", round((now - "then") * 100.0 / nullif("then", 0), 6)::DOUBLE AS growth, CASE WHEN "then" = 0 OR (now - "then") * 100.0 / "then" > 10 THEN 'up' WHEN (now - "then") * 100.0 / "then" < -10 THEN 'down' ELSE 'stable' END AS trend
FROM c ORDER BY n DESC, term LIMIT 20""")
def _(t: Tables):
    p = search.popular_terms(t.documents, "text", F.col("doc_id") % 3 == 0, 20)
    return p.withColumn("growth", F.round("growth", 6))


@query("q06_term_volume", f"WITH {WORDS} SELECT count(*) AS total_terms, count(DISTINCT term) AS unique_terms FROM w")
def _(t: Tables):
    return search.term_volume(t.documents, "text")


@query("q07_substring_search", """SELECT 'player' AS kind, c_name AS name FROM customer WHERE c_name ILIKE '%0001%' UNION SELECT 'spell', p_name FROM part WHERE p_name ILIKE '%0001%'
UNION SELECT 'encounter', o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%0001%'""")
def _(t: Tables):
    return search.substring_search({"player": (t.customer, "c_name"), "spell": (t.part, "p_name"), "encounter": (t.orders, "o_orderpriority")}, "0001")


@query("u03_global_search", """SELECT 'player' AS kind, c_name AS name FROM customer WHERE c_name ILIKE '%ig%' UNION SELECT 'spell', p_name FROM part WHERE p_name ILIKE '%ig%'
UNION SELECT 'encounter', o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%ig%' UNION SELECT 'event', event_type FROM events WHERE event_type ILIKE '%ig%'""")
def _(t: Tables):
    return search.substring_search({"player": (t.customer, "c_name"), "spell": (t.part, "p_name"), "encounter": (t.orders, "o_orderpriority"),
                                    "event": (t.events, "event_type")}, "ig")


# --- tiers and sets ---------------------------------------------------------------------------------

# Some rows older than a week are still in the hot tier alone, some new ones are in the warm tier already, most are in both.
@query("u01_tiers", """SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20' AND event_id % 13 <> 0 OR event_id % 11 = 0 THEN 'hot' ELSE 'warm' END AS tier FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-28'""")
def _(t: Tables):
    e = t.events
    late, early = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    frames = {"hot": e.filter((F.col("ts") > F.lit("2024-01-20").cast("timestamp")) & ~early | late), "warm": e.filter(~late), "cold": e.filter(F.col("ts") < F.lit("2024-01-05").cast("timestamp"))}
    return listing.union_tiers(frames, "ts", datetime(2024, 1, 10), datetime(2024, 1, 28), "event_id").select("event_id", "tier")


@query("u02_distinct_participants", "WITH {EV} SELECT encounter_key, source_guid AS guid FROM ev UNION SELECT encounter_key, dest_guid FROM ev")
def _(t: Tables):
    e = combat_events(t)
    return e.select("encounter_key", F.explode(F.array("source_guid", "dest_guid")).alias("guid")).distinct()


@query("u04_new_files", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)")
def _(t: Tables):
    known = t.documents.filter("doc_id < 5").select("source").distinct()
    return listing.new_files(t.documents.select("source").distinct(), known, "source")


@query("u04_leak_check", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def _(t: Tables):
    return listing.leaked(t.customer.filter("c_nationkey = 3"), t.customer.filter("c_nationkey = 4"), "c_custkey")


# --- lists --------------------------------------------------------------------------------------------

@query("t01_recent", "SELECT o_orderkey, epoch_us(o_orderdate) AS start_us FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(t: Tables):
    return listing.recent(t.orders, "o_orderdate", "o_orderkey", 20).select("o_orderkey", us("o_orderdate").alias("start_us"))


@query("t01_recent_guild", f"WITH {ENC} SELECT encounter_key, epoch_us(start_ts) AS start_us FROM enc WHERE guild_id = 4 ORDER BY start_ts DESC, encounter_key DESC LIMIT 10")
def _(t: Tables):
    return listing.recent(filters.for_guild(encounters(t), 4), "start_ts", "encounter_key", 10).select("encounter_key", us("start_ts").alias("start_us"))


@query("t02_top_performers", f"""WITH {LOC} SELECT l_orderkey AS encounter_key, c_custkey AS character_id, c_name, l_extendedprice AS dps FROM loc
WHERE c_nationkey = 3 AND l_orderkey % 2 = 0 AND o_orderpriority LIKE '%URG%' AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY l_extendedprice DESC, l_orderkey, c_custkey, l_linenumber LIMIT 15""")
def _(t: Tables):
    rows = metric_rows(t).select(
        F.col("l_orderkey").alias("encounter_key"), F.col("c_custkey").alias("character_id"), "c_name", F.col("l_extendedprice").alias("dps"),
        F.col("c_nationkey").alias("guild_id"), F.when(F.col("l_orderkey") % 2 == 0, "raid").otherwise("mythic_plus").alias("encounter_type"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("start_ts"), F.col("l_linenumber").alias("row_id"))
    top = listing.top_performers(rows, "dps", 15, guild=3, encounter_type="raid", name="URG", since=F.lit("1996-01-01").cast("timestamp"))
    return top.select("encounter_key", "character_id", "c_name", "dps")


@query("t04_page", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 25) AS BIGINT) AS pages, true AS has_next
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def _(t: Tables):
    p = listing.page(t.orders.filter("o_orderstatus = 'F'"), "o_totalprice", ["o_orderdate", "o_totalprice"], "o_orderkey", True, 25, 50)
    return p.select("o_orderkey", "o_totalprice", "total", "pages", "has_next")


@query("t04_page_fallback_sort", """SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 10""")
def _(t: Tables):
    return listing.page(t.customer, "password", ["c_name", "c_acctbal"], "c_custkey", False, 10).select("c_custkey", "total")


@query("t08_replay", """WITH {EV} SELECT line_no, epoch_us(ts) AS at_us, CASE WHEN event_type = 'UNIT_DIED' THEN 'death' END AS marker FROM ev
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND event_type IN ('UNIT_DIED', 'SPELL_DAMAGE') ORDER BY ts, line_no LIMIT 100""")
def _(t: Tables):
    r = listing.replay(combat_events(t), ["UNIT_DIED", "SPELL_DAMAGE"], F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-06").cast("timestamp"), 100)
    return r.select("line_no", us("ts").alias("at_us"), "marker")


@query("t08_character_events", """WITH {EV} SELECT line_no, epoch_us(ts) AS at_us, amount FROM ev WHERE (source_guid = 'Player-12' OR dest_guid = 'Player-12') AND event_type = 'SPELL_HEAL'
  AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts, line_no LIMIT 500""")
def _(t: Tables):
    mine = combat_events(t).filter((F.col("source_guid") == "Player-12") | (F.col("dest_guid") == "Player-12"))
    r = listing.replay(mine, ["SPELL_HEAL"], F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 500)
    return r.select("line_no", us("ts").alias("at_us"), "amount")


@query("q01_scoped_search", f"""WITH s AS (SELECT 'character' AS kind, c_custkey::VARCHAR AS id, c_name AS title, {hit_sql('c_name', '00')}::DOUBLE AS score FROM customer
  UNION ALL SELECT 'spell', p_partkey::VARCHAR, p_name, {hit_sql('p_name', '00')}::DOUBLE FROM part UNION ALL SELECT 'guild', n_nationkey::VARCHAR, n_name, {hit_sql('n_name', '00')}::DOUBLE FROM nation)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, kind, id LIMIT 50""")
def _(t: Tables):
    return search.scoped_search({"character": (t.customer, "c_custkey", "c_name"), "spell": (t.part, "p_partkey", "p_name"),
                                 "guild": (t.nation, "n_nationkey", "n_name")}, "00")
