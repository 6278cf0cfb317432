"""What a task of the toxicity model holds doesn't grow with its batch, and workers give back what they don't need."""

import re
from collections import Counter
from pathlib import Path

import pandas as pd

from fraylens.llm import shared, toxicity


def test_entries_leave_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 100)
    texts = [" ".join(f"Word{chr(97 + i % 26)}{k}." for k in range(i % 9)) for i in range(300)] + ["", "..."]
    batch = pd.DataFrame({"text": texts, "toxic": [i % 2 for i in range(302)], "fold": [i % 4 for i in range(302)]})
    parts = list(toxicity.entries(iter([batch, batch])))
    want: Counter = Counter()
    for text, toxic, fold in batch.itertuples(index=False):
        words = {w.lower().strip(".") for w in text.split()} - {""}
        want.update([(w, False, toxic, fold) for w in words] + [(s, True, toxic, fold) for s in {w[:4] for w in words if len(w) > 4}])
    assert Counter(t for p in parts for t in p.itertuples(index=False, name=None)) == {k: 2 * n for k, n in want.items()}
    assert max(map(len, parts)) < 100 + 9 and len(parts) > 10
    assert [len(p) for p in toxicity.entries(iter([]))] == [0]


def test_release_returns_freed_memory():
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    objects = [bytes(700) for _ in range(250_000)]
    pinned = objects[::1000]  # they keep the heap from shrinking by itself
    del objects
    before = held()
    shared.release()
    assert len(pinned) == 250 and before - held() > 80
