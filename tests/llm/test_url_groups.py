"""Groups of URLs keep their statistics, however many there are."""

import pytest

from fraylens.llm import url_filter


@pytest.mark.parametrize("entries", [0, 2])
def test_url_statistics_of_any_number_of_groups(spark, monkeypatch, entries):
    """More suffixes and beginnings than the table that is sent holds: the same scores and verdicts."""
    urls = [f"http://s{i}.example.{t}/{p}/{i}" for i in range(30) for t in ("com", "net", "org") for p in ("en", "es", "fr", "de", "it", "pt")]
    df = spark.createDataFrame(list(enumerate([*urls, None, "no scheme"])), "page_id long, url string")
    judged = lambda: sorted((r["page_id"], r["verdict"], round(r["block_score"], 9)) for r in url_filter.judge(df).collect())
    want = judged()
    assert len({s for *_, s in want}) > 1
    monkeypatch.setattr(url_filter, "ENTRIES", entries or 0.5)
    assert judged() == want
