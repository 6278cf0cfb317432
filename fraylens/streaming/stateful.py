"""Stateful streams with timers: live encounters and keystone runs, top lists of open encounters, delivery of client messages.

Each is a state machine per key under ``transformWithState`` (state in RocksDB; nothing earlier is read again). What reaches Python is small: boundary
rows for encounters, and for the other two sums or ranges that each Arrow batch has formed before the shuffle. Every output row has a ``revision`` that
grows per key, so a sink keeps the newest version of a row whatever batch it came in (``newest(..., ["revision"])``). The state store must be RocksDB:
``live.run_available`` sees to it in any session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraylens.functions import classify as C
from fraylens.operators.metrics import effective
from fraylens.operators.segments import BOUNDARIES, END, RUN_END, RUN_START, START

# --- live encounters ------------------------------------------------------------------------------

ENCOUNTERS = ("guild_id long, encounter_type string, encounter_id long, boss_id long, pull_number long, start_us long, end_us long, success boolean, "
              "status string, revision long")


class EncounterMachine(StatefulProcessor):
    """Boundary rows of one guild, in event time.

    State: rows that the watermark hasn't passed (list), the open encounter or run (value), pulls per boss (map), and the revision with the last
    announced encounter and boundary (value). A timer at the earliest waiting row releases rows as the watermark moves; without waiting rows it ends
    what has seen no boundary for ``idle`` seconds. A quiet guild keeps its pull counters and nothing else that grows.
    """

    def __init__(self, idle_seconds: float | None = None):
        self.idle_us = None if idle_seconds is None else int(idle_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, line_no long, event_type string, boss_id long, success boolean")
        self.open = handle.getValueState("open", "encounter_type string, encounter_id long, boss_id long, pull_number long, start_us long")
        self.pulls = handle.getMapState("pulls", "boss_id long", "n long")
        self.mark = handle.getValueState("mark", "revision long, announced long, last_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.pending.appendList([(r["us"], r["line_no"], r["event_type"], r["boss_id"], r["success"]) for r in rows])
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def _advance(self, guild: int, watermark_ms: int) -> list[Row]:
        ready_us = (watermark_ms + 1) * 1000
        rows = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        ready, wait = [r for r in rows if r[0] < ready_us], [r for r in rows if r[0] >= ready_us]
        revision, announced, last_us = tuple(self.mark.get()) if self.mark.exists() else (0, -1, 0)
        current = tuple(self.open.get()) if self.open.exists() else None
        out: list[Row] = []

        def emit(what: tuple, end_us: int | None, success: bool | None, status: str) -> None:
            out.append(Row(guild_id=guild, encounter_type=what[0], encounter_id=what[1], boss_id=what[2], pull_number=what[3], start_us=what[4],
                           end_us=end_us, success=success, status=status, revision=revision + len(out) + 1))

        def quiet(until_us: int) -> bool:
            return current is not None and self.idle_us is not None and until_us - last_us > self.idle_us

        for us, line, kind, boss, success in ready:
            if quiet(us):
                emit(current, None, None, "idle")
                current = None
            in_run = current is not None and current[0] == "mythic_plus"
            if kind == RUN_START or kind == START and not in_run:
                if current:
                    emit(current, None, None, "replaced")
                n = 0
                if kind == START:
                    n = 1 + (self.pulls.getValue((boss,))[0] if self.pulls.containsKey((boss,)) else 0)
                    self.pulls.updateValue((boss,), (n,))
                current = ("raid" if kind == START else "mythic_plus", line, boss, n, us)
            elif kind == RUN_END and in_run or kind == END and current and not in_run and current[2] == boss:
                emit(current, us, success, "closed")
                current = None
            last_us = us
        if not wait and quiet(watermark_ms * 1000):
            emit(current, None, None, "idle")
            current = None
        if current and announced != current[1]:
            emit(current, None, None, "in_progress")
            announced = current[1]
        if ready:
            self.pending.clear()
            if wait:
                self.pending.put(wait)
        if current:
            self.open.update(current)
        else:
            self.open.clear()
        self.mark.update((revision + len(out), announced, last_us))
        self._wake(watermark_ms, wait[0][0] // 1000 if wait else (last_us + self.idle_us) // 1000 + 1 if current and self.idle_us is not None else None)
        return out

    def _wake(self, watermark_ms: int, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(max(at_ms, watermark_ms + 1))


def live_encounters(boundaries: DataFrame, delay: str = "10 minutes", idle_seconds: float | None = None) -> DataFrame:
    """Raid encounters and keystone runs per guild from a stream of boundary rows, exact under reordering within ``delay``.

    Input: guild_id, ts, line_no, event_type, boss_id (of a run: its dungeon), success. An encounter is announced as ``in_progress`` while it is open
    and follows later as ``closed`` (its own end), ``replaced`` (the next start came first) or ``idle``. Inside a run, bosses open no encounter; an end
    with another boss id closes nothing. The newest revision of (guild_id, encounter_id) counts. Rows behind the watermark are dropped by Spark.
    """
    kind = F.col("event_type")
    d = boundaries.where(kind.isin(BOUNDARIES)).withWatermark("ts", delay).select(
        F.col("guild_id").cast("long").alias("guild_id"), "ts", F.unix_micros("ts").alias("us"), F.col("line_no").cast("long").alias("line_no"), "event_type",
        F.coalesce("boss_id", F.lit(-1)).cast("long").alias("boss_id"), F.coalesce("success", F.lit(False)).alias("success"))
    return d.groupBy("guild_id").transformWithState(EncounterMachine(idle_seconds), ENCOUNTERS, "Update", "EventTime")


# --- live top lists -----------------------------------------------------------------------------------

TOP = ("encounter_key long, rank long, guid string, damage long, healing long, dps double, duration_seconds double, participants long, revision long")
PARTS = "encounter_key long, guid string, damage long, healing long, first_us long, last_us long, ts timestamp"


def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per encounter and player of each Arrow batch."""
    for batch in batches:
        if len(batch):
            yield batch.groupby(["encounter_key", "guid"], as_index=False).agg({"damage": "sum", "healing": "sum", "first_us": "min", "last_us": "max", "ts": "max"})


class TopList(StatefulProcessor):
    """Totals per player of one encounter; emits the best ``n`` when the list has changed.

    State: totals per player (map), the encounter's first and last event with the revision (value), the players of the list last sent (list). It is dropped
    ``keep_seconds`` of event time after the encounter's last event.
    """

    def __init__(self, n: int, keep_seconds: float):
        self.n, self.keep_ms = n, int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.players = handle.getMapState("players", "guid string", "damage long, healing long")
        self.span = handle.getValueState("span", "first_us long, last_us long, participants long, revision long")
        self.sent = handle.getListState("sent", "guid string, damage long, healing long, first_us long, last_us long, participants long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, participants, revision = tuple(self.span.get()) if self.span.exists() else (1 << 62, -(1 << 62), 0, 0)
        new: dict[str, list[int]] = {}
        for r in rows:
            t = new.setdefault(r["guid"], [0, 0])
            t[0] += r["damage"]
            t[1] += r["healing"]
            first, last = min(first, r["first_us"]), max(last, r["last_us"])
        # only players with new rows can enter or move within the list
        before = [tuple(s) for s in self.sent.get()] if self.sent.exists() else []
        totals = {s[0]: (s[1], s[2]) for s in before}
        for guid, (damage, healing) in new.items():
            if self.players.containsKey((guid,)):
                old = self.players.getValue((guid,))
                damage, healing = damage + old[0], healing + old[1]
            else:
                participants += 1
            self.players.updateValue((guid,), (damage, healing))
            totals[guid] = (damage, healing)
        best = sorted(((-d, g, h) for g, (d, h) in totals.items() if d > 0))[:self.n]
        now = [(g, -d, h, first, last, participants) for d, g, h in best]
        changed = now != before
        self.span.update((first, last, participants, revision + changed))
        self._expire(last)
        if changed:
            self.sent.put(now)
            seconds = (last - first) / 1e6
            for rank, (guid, damage, healing, *_) in enumerate(now, 1):
                yield Row(encounter_key=key[0], rank=rank, guid=guid, damage=damage, healing=healing, dps=damage / seconds if seconds > 0 else None,
                          duration_seconds=seconds, participants=participants, revision=revision + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.players.clear()
        self.span.clear()
        self.sent.clear()
        return iter(())

    def _expire(self, last_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last_us // 1000 + self.keep_ms)


def live_top(events: DataFrame, n: int = 5, delay: str = "10 minutes", keep_seconds: float = 86400.0) -> DataFrame:
    """The best ``n`` players by damage of every encounter with dps over its duration so far and its number of participants, sent on change.

    Input: encounter_key, source_guid, ts, event_type, amount, overhealing. The newest revision of (encounter_key, rank) counts; ties go to the first
    guid. An encounter may last over any number of days; it is forgotten ``keep_seconds`` after its last event.
    """
    kind = F.col("event_type")
    zero = F.lit(0).cast("long")
    d = events.where(F.col("encounter_key").isNotNull() & F.col("source_guid").isNotNull()).select(
        F.col("encounter_key").cast("long").alias("encounter_key"), F.col("source_guid").alias("guid"),
        F.coalesce(F.when(kind.isin(C.DAMAGE_LIKE), F.col("amount").cast("long")), zero).alias("damage"),
        F.coalesce(F.when(kind.isin(C.HEAL_LIKE), effective().cast("long")), zero).alias("healing"), F.unix_micros("ts").alias("first_us"), F.unix_micros("ts").alias("last_us"), "ts")
    return d.mapInPandas(partial_sums, PARTS).withWatermark("ts", delay).groupBy("encounter_key").transformWithState(TopList(n, keep_seconds), TOP, "Update", "EventTime")


# --- delivery --------------------------------------------------------------------------------------------

DELIVERY = ("client_id string, acked long, contiguous long, received long, duplicates long, missing long, pending long, gaps array<struct<low: long, high: long>>, revision long")


def partial_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of consecutive numbers per client of each Arrow batch, with the number of rows behind them."""
    for batch in batches:
        if not len(batch):
            continue
        b = batch.sort_values(["client_id", "seq"], kind="stable")
        new = (b["client_id"] != b["client_id"].shift()) | (b["seq"] > b["seq"].shift() + 1)
        runs = b.groupby(new.cumsum().to_numpy()).agg(client_id=("client_id", "first"), low=("seq", "min"), high=("seq", "max"), rows=("seq", "size"))
        yield runs.reset_index(drop=True)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending ranges that hold the same numbers."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


class Delivery(StatefulProcessor):
    """Numbers received from one client, as ascending disjoint ranges.

    State: the ranges (list; one for a client without losses) and the number of rows with the revision (value). ``lost_after``: holes more than that many numbers
    behind the newest are given up (they stay counted as missing), which bounds the list.
    """

    def __init__(self, first: int | None = None, lost_after: int | None = None):
        self.first, self.lost_after = first, lost_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getListState("ranges", "low long, high long")
        self.seen = handle.getValueState("seen", "rows long, given_up long, revision long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, given_up, revision = tuple(self.seen.get()) if self.seen.exists() else (0, 0, 0)
        ranges = [tuple(r) for r in self.ranges.get()] if self.ranges.exists() else []
        for r in rows:
            total += r["rows"]
            ranges.append((r["low"], r["high"]))
        ranges = merged(ranges)
        if self.lost_after is not None:
            while len(ranges) > 1 and ranges[1][0] <= ranges[-1][1] - self.lost_after:
                given_up += ranges[1][0] - ranges[0][1] - 1
                ranges[0:2] = [(ranges[0][0], ranges[1][1])]
        start = ranges[0][0] if self.first is None else self.first
        self.ranges.put(ranges)
        self.seen.update((total, given_up, revision + 1))
        holes = ([(start, ranges[0][0] - 1)] if start < ranges[0][0] else []) + [(a[1] + 1, b[0] - 1) for a, b in zip(ranges, ranges[1:])]
        received = sum(high - low + 1 for low, high in ranges) - given_up
        contiguous = holes[0][0] - 1 if holes else ranges[-1][1]
        yield Row(client_id=key[0], acked=ranges[-1][1], contiguous=contiguous, received=received, duplicates=total - received,
                  missing=sum(high - low + 1 for low, high in holes) + given_up, pending=sum(high - low + 1 for low, high in ranges if low > contiguous),
                  gaps=[Row(low=low, high=high) for low, high in holes], revision=revision + 1)


def live_delivery(messages: DataFrame, first: int | None = None, lost_after: int | None = None) -> DataFrame:
    """Per client: the highest number processed, up to where all are there, what came twice, what is missing (numbers and gaps) and what waits behind a gap.

    Input: client_id, seq; repeated and reordered messages at will. Numbering starts with the smallest number seen, or with ``first``. The newest revision of a
    client counts. Late numbers fill their gap whenever they come, unless ``lost_after`` has given it up.
    """
    d = messages.where(F.col("client_id").isNotNull() & F.col("seq").isNotNull()).select("client_id", F.col("seq").cast("long").alias("seq"))
    return d.mapInPandas(partial_ranges, "client_id string, low long, high long, rows long").groupBy("client_id").transformWithState(
        Delivery(first, lost_after), DELIVERY, "Update", "None")
