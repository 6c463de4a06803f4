import collections
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import props, sketches

TEXTS = [
    '{"k": 1, "a": {"b": {"c": [1, 2.5, "x", null, {"d": true}]}}}', '{"k": "1"}', "[]", "[1, [2, []]]", '"text"', "null", "7", '{"k": 1', "", " ", None, "{}", '{"é": -3, "k": 10000000000}', '{"items": [{"sku": 5, "qty": 2}, {"sku": 5, "qty": 1}, {"sku": "5"}, {"sku": 6, "qty": "many"}, 3]}',
    '{"items": {"sku": 5}}', '{"items": null}', '{"items": [{"qty": 1}]}',
]


def inside(path, v, found):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    found[path, kind].append(v)
    for key, x in v.items() if kind == "object" else []:
        inside(f"{path}.{key}", x, found)
    for x in v if kind == "array" else []:
        inside(f"{path}[]", x, found)


def test_keys_and_typed_values(spark):
    """Against the json module: nested, bad, missing and repeated texts, values of several types at one path, clashing columns."""
    texts = TEXTS + TEXTS[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "click_id long, props string").withColumns({c: F.lit("x") for c in ("id", "path", "kind", "v", "n", "found", "open", "row", "item")})
    found, rest = collections.defaultdict(list), collections.Counter()
    for t in texts:
        try:
            inside("$", json.loads(t), found) if t is not None else rest.update(["missing"])
        except ValueError:
            rest["bad"] += 1
    want = {(None, k): (n, 0, None, None) for k, n in rest.items()}
    for (path, kind), vs in found.items():
        several = {float(v) if kind == "number" else v for v in vs} if kind in ("number", "string") else ()
        numbers = [float(v) for v in vs] if kind == "number" else [None]
        want[path, kind] = (len(vs), len(several), min(numbers, default=None) if kind == "number" else None, max(numbers) if kind == "number" else None)
    got = {(r.path, r.kind): (r.n, r.n_different, r.low, r.high) for r in props.prop_keys(df).collect()}
    assert got == want
    assert {(r.sku, r.n_clicks, r.quantity) for r in props.item_demand(df).collect()} == {(5, 1, 3), (6, 1, 0)}
    assert props.prop_keys(df.limit(0)).count() == props.item_demand(df.limit(0)).count() == 0


def test_deep_json_stays_in_its_container(spark):
    deep = "[" * 9 + "1" + "]" * 9
    got = [r.path for r in props.prop_keys(spark.createDataFrame([(1, deep)], "click_id long, props string")).collect()]
    assert sorted(got) == sorted("$" + "[]" * k for k in range(props.DEPTH + 1))


@pytest.mark.parametrize("clients", [5, 30_000])
def test_sketches_merge_over_days(spark, clients):
    """Sketches of days, stored and read again, give what one sketch of all would, within the stated error of the exact count."""
    rng = random.Random(clients)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=rng.randrange(240)), rng.randrange(clients), rng.choice(["a", None]), rng.choice([rng.gauss(0, 9), None, float("nan")])) for _ in range(30_000)]
    df = spark.createDataFrame(rows + [(None, 1, "a", 1.0)], "ts timestamp_ntz, client_id long, kind string, value double")
    daily = sketches.daily_sketches(df)
    assert daily.count() == 20
    got = {r.kind: r.e for r in sketches.merged(daily).select("kind", F.hll_sketch_estimate("clients").alias("e")).collect()}
    for kind, name in (("a", "a"), (None, "none")):
        exact = len({c for _, c, k, _ in rows if k == kind})
        assert abs(got[name] - exact) <= sketches.STATED * exact + 1
    assert all(r.clients_within and r.n_medians_within == r.n_days == 10 for r in sketches.sketched_activity(df).collect())


def test_levels_are_spread_and_made_once(spark):
    """Containers of any number of values, first ones too, stand once each; the plan has no lambda and makes a value's schema once."""
    df = spark.createDataFrame([(1, '[[], {}, [[{"a": [1, {"b": []}]}, 2], 3], {"c": {"d": null}}]')], "click_id long, props string")
    found = props.values(df)
    text = found._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in text and text.count("schema_of_variant") == 1, text
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.path].append(r.kind)
    model = collections.defaultdict(list)
    inside("$", json.loads(df.head().props), model)
    assert {k: sorted(v) for k, v in got.items()} == {p: sorted(k for (q, k), vs in model.items() if q == p for _ in vs) for p, _ in model}
