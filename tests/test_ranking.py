import collections
import random

from pyspark.sql import functions as F

from basalt.operators import ranking

SCHEMA = "page_id long, url string, html string"


def html(targets):
    return "".join(f'<a href="{t}">x</a>' for t in targets)


def test_communities_along_a_chain(spark):
    """A chain of 300 pages is one community within few rounds; a target of all pages ties none; nulls and repeats."""
    rows = [(i, "u", html([f"/l{i}", f"/l{i + 1}", "/home"])) for i in range(300)] + [(7, "u", html(["/l7", "/z"])), (900, "u", html(["/z2", "/home"])), (901, None, None), (None, "u", html(["/l1"]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("target", "community", "least", "weight")})
    got = {r.page_id: (r.community, r.n_pages) for r in ranking.communities(df, most=24).collect()}
    assert got == {i: (0, 300) for i in range(300)} | {900: (900, 1), 901: (901, 1)}
    assert ranking.communities(df.limit(0)).count() == ranking.authorities(df.limit(0)).count() == 0


def test_authorities_against_plain_code(spark):
    rng = random.Random(3)
    pages = {i: rng.sample(range(40), rng.randrange(0, 8)) + ([99] if i % 3 else []) for i in range(120)}
    got = {r.target: (r.n_pages, r.authority) for r in ranking.authorities(spark.createDataFrame([(i, "u", html(f"/{t}" for t in ts)) for i, ts in pages.items()], SCHEMA)).collect()}
    hubs = {i: 1.0 for i, ts in pages.items() if ts}
    for _ in range(ranking.ROUNDS):
        found = collections.Counter()
        for i, ts in pages.items():
            for t in ts:
                found[t] += hubs[i]
        found = {t: x / max(found.values()) for t, x in found.items()}
        hubs = {i: sum(found[t] for t in ts) for i, ts in pages.items() if ts}
        hubs = {i: x / max(hubs.values()) for i, x in hubs.items()}
    assert {t: n for t, (n, _) in got.items()} == {f"/{t}": sum(t in ts for ts in pages.values()) for t in found}
    assert all(abs(got[f"/{t}"][1] - x) < 2e-6 for t, x in found.items())
