import datetime as dt
import random

from pyspark.sql import Row

from marginlake.streaming import throttle_live
from tests.helpers import dicts
from tests.test_streaming import brute_force_windows


def test_throttle_stream_equals_brute_force(spark, tmp_path):
    """Files whose events overlap within the delay, a null key, and a last event that moves the watermark."""
    rng = random.Random(6)
    base = dt.datetime(2025, 1, 1)
    events = [(rng.choice(["hot", "hot", "a", "b", None]), base + dt.timedelta(seconds=rng.randrange(4000), milliseconds=rng.choice([0, 1]))) for _ in range(400)]
    events += [("edge", base + dt.timedelta(seconds=s)) for s in (0, 60, 61)]
    files = [[], [], []]
    for e in events:
        files[min(2, ((e[1] - base).seconds + rng.choice([0, 0, 90])) // 1500)].append(e)
    for rows in [*files, [("clock", base + dt.timedelta(days=9))]]:
        spark.createDataFrame(rows, "who string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("who string, ts timestamp").parquet(str(tmp_path / "in"))
        found = throttle_live.audit_stream(stream, key="who", at="ts", limit=4, window=60, delay="100 seconds")
        throttle_live.save_windows(found, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = dicts(spark.read.parquet(str(tmp_path / "out")))
    rows = sorted((r["key"] or "~", r["window_start"], r["events"], r["allowed"], r["rejected"]) for r in got)
    assert rows == brute_force_windows([(k or "~", t) for k, t in events], 60, 4)


class FakeState:
    """A key's state and timers, and how often they were called."""

    def __init__(self):
        self.value, self.items, self.timers, self.calls = None, [], set(), 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return FakeList(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.update(None)


class FakeList:
    def __init__(self, state):
        self.state = state

    def appendValue(self, value):
        self.put([*self.state.items, value])

    def get(self):
        self.state.calls += 1
        return iter(self.state.items)

    def put(self, values):
        self.state.calls += 1
        self.state.items = list(values)

    def clear(self):
        self.put([])


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def played(batches, window, limit):
    """Windows of one key whose batches come with a watermark each, as the engine calls the processor."""
    state, out = FakeState(), []
    throttle = throttle_live.Throttle(limit, window * 1_000_000)
    throttle.init(state)
    for rows, ms in batches:
        if rows:
            assert list(throttle.handleInputRows(("k",), iter([Row(key="k", at=t) for t in rows]), Watermark(0))) == []
        due = sorted(t for t in state.timers if t <= ms)
        state.timers -= set(due)
        for _ in due:
            out += throttle.handleExpiredTimer(("k",), Watermark(ms), None)
    return out, state


def test_calls_to_the_state_do_not_grow_with_events():
    base = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    calls = []
    for n in (10, 1000):
        rows = [base + dt.timedelta(seconds=k) for k in range(n)]
        calls.append(played([(rows, 0), ([], int(base.timestamp() * 1000) + 10**7)], 60, 4)[1].calls)
    assert calls[0] == calls[1] < 10


def test_chunks_give_the_windows_of_brute_force(monkeypatch):
    """Instants that come again in later batches and chunks, late ones, and what stays behind the watermark."""
    monkeypatch.setattr(throttle_live, "CHUNK", 3)
    rng = random.Random(8)
    base = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda s: base + dt.timedelta(seconds=s)
    ms = lambda s: int(at(s).timestamp() * 1000)
    batches, events = [], []
    for k in range(12):
        rows = [at(rng.randrange(k * 50, k * 50 + 120)) for _ in range(rng.choice([0, 7, 30]))]
        events += [("k", t) for t in rows]
        batches.append((rows, ms(k * 50)))
    out, state = played([*batches, ([], ms(10_000))], 40, 4)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    rows = sorted((r["key"], epoch + dt.timedelta(microseconds=r["window_start"]), r["events"], r["allowed"], r["rejected"]) for r in out)
    assert rows == brute_force_windows(events, 40, 4)
    assert state.value is None and state.items == [] and not state.timers
