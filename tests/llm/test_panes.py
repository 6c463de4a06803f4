import collections
import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from basalt.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
EPOCH = datetime.datetime(1970, 1, 1)
HOUR = 3_600_000_000


def plain(rows, batches):
    """The contract by hand: rows of (click_id, ts, arrived_at, client_id, kind, value, props)."""
    once = {}
    first = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (first(r[2] and (r[2] - EPOCH)), r[1], (r[4] is not None, r[4] or ""), first(r[5]))):
        once.setdefault(r[0], r)
    dealt = collections.defaultdict(list)
    for c, ts, arrived, _, kind, value, _ in once.values():
        day = ((arrived or ts) - EPOCH).days
        delay = max(0, zlib.crc32(str(c).encode()) % 30 - 23) if c is not None else 0
        event = (ts - EPOCH) // datetime.timedelta(microseconds=1) - (day - day % batches) * 24 * HOUR
        x = 0 if value is None or not abs(value) < 1e12 else value * 100 + 0.5
        dealt[min(batches - 1, day % batches + delay)].append((c, kind if kind is not None else "none", event, int(x // 1)))
    out, state, w = [], {}, None
    for b in range(batches):
        old, new = {k: v[:2] for k, v in state.items()}, set()
        for c, kind, event, cents in dealt[b]:
            hour = event // HOUR
            if w is not None and w >= (hour + 97) * HOUR:
                out.append((b, hour, c, 1, cents, "late", kind))
            else:
                s = state.setdefault((kind, hour), [0, 0, False])
                s[0] += 1
                s[1] += cents
                new.add((kind, hour))
        for (kind, hour), s in list(state.items()):
            if not s[2] and w is not None and w >= (hour + 7) * HOUR:
                out.append((b, hour, -1, s[0], s[1], "emit", kind))
                s[2] = True
            elif s[2] and (kind, hour) in new:
                out += [(b, hour, -1, *old[kind, hour], "retract", kind), (b, hour, -1, s[0], s[1], "replace", kind)]
            if w is not None and w >= (hour + 97) * HOUR:
                del state[kind, hour]
        w = max([x for x in [w] if x is not None] + [e for _, _, e, _ in dealt[b]], default=None)
    out += [(batches - 1, hour, -1, s[0], s[1], "final", kind) for (kind, hour), s in state.items() if not s[2]]
    return out


def test_panes_by_hand(spark, monkeypatch):
    """Nulls in all columns, repeats, broken times and numbers, hours before 1970, batches without rows, clashing columns; sums sent on early."""
    rng = random.Random(5)
    monkeypatch.setattr(panes, "HELD", 3)
    day = datetime.datetime(2024, 1, 1)  # of the third batch of four
    rows = []
    for i in range(400):
        ts = day + datetime.timedelta(days=rng.choice([0, 1, 4, 5, 8]), seconds=rng.randrange(86400), microseconds=rng.randrange(10**6))
        late = datetime.timedelta(hours=rng.choice([0, 0, 0, 5, 30, 110]))
        rows.append((i, ts, ts + late, 1, rng.choice(["view", "view", "view", None, "none"]), rng.choice([None, 1.005, -2.5, 0.0, 7.25, float("inf"), float("nan")]), "{}"))
    rows += rows[:20] + [(None, day, None, None, None, None, None), (None, day, None, None, None, None, None), (900, None, day, 1, "view", 1.0, None), (901, datetime.datetime(1969, 12, 30), day, 1, "view", 1.0, None), (902, datetime.datetime(1900, 1, 1), datetime.datetime(1900, 1, 1), 1, "view", 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("batch", "hour", "day", "shard", "n_rows", "cents", "record", "event_ms", "at")})
    got = [tuple(r) for r in panes.revise_panes(df, batches=4).collect()]
    want = plain(rows, 4)
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(want)
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"}


def test_panes_empty(spark):
    assert panes.revise_panes(spark.createDataFrame([], SCHEMA), batches=2).count() == 0


@pytest.mark.parametrize(("hour", "w", "want"), [(0, None, (False, False)), (0, 7 * 3_600_000, (True, False)), (0, 7 * 3_600_000 - 1, (False, False)), (-1, 96 * 3_600_000, (True, True)), (-1, 96 * 3_600_000 - 1, (True, False))])
def test_deadlines(hour, w, want):
    assert (panes.due(hour, w), panes.closed(hour, w)) == want
