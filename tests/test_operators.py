import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt import plans
from basalt.functions import FUNCTION_WORDS
from basalt.operators import capture, check, compress, digest, graph, knowledge

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "events", "documents", "pages", "benchmark", "conversations", "clicks"]


def normal(rows, columns):
    return sorted(tuple("\0" if r[c] is None else str(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in all columns, empty and long texts, ties, repeated rows, Chinese, short claims, further columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    long = "lorem ipsum dolor sit amet " * 4000
    five = "the river and the stone are in the valley by the hill"
    texts = [None, "", " \n", five, five, five.upper() + "!", long, "river stone", "stone river", "我们的城市，和平与发展，其他的", "a", "b c", f"x {five} y"]
    docs = [(i, t, ["en", "zh", None, "fr"][i % 4] if i != 9 else "zh", ["s", None, "t"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [(3, five, "en", "s", len(five)), (None, five, "en", "s", len(five)), (None, None, None, None, None), (20, "river stone hill", "en", "u", 16), (21, "hill river stone", "en", "u", 16)]
    frames = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(1, five), (2, "b c"), (3, "a"), (4, ""), (5, None), (6, "no such words stand here at all"), (7, "river stone"), (8, "and the stone"), (None, five)], "item_id long, text string"),
        "conversations": ([(1, 0, "user", five), (1, 1, "assistant", f"well {five}"), (1, 1, "assistant", "tie"), (1, None, "user", "late"), (1, 2, None, None), (2, 0, "user", None), (None, 0, "user", five), (3, 5, "user", five), (3, 6, None, five), (3, 7, "assistant", five)], "conv_id long, turn long, role string, text string"),
        "pages": ([(1, "u", None), (2, None, '<a href="/x">x</a>'), (3, "v", ""), (4, "w", "<title>t</title><h1>h</h1>"), (4, "w", "<title>t</title><h1>h</h1>"), (None, None, None)], "page_id long, url string, html string"),
        "events": ([(1, "2024-01-01 10:00:00", "view"), (2, "2024-01-01 23:59:59", "view"), (3, "2024-01-03 00:00:00", "view"), (4, None, "view"), (5, "2024-01-01 00:00:00", None), (5, "2024-01-01 00:00:00", None)], "event_id long, at string, event_type string"),
        "clicks": (
            [(i, f"2024-01-{1 + i // 6:02} {4 * (i % 6):02}:{(7 * i) % 60:02}:30.25", f"2024-01-{1 + i // 6 + (3 if i % 11 == 10 else 0):02} 23:00:00", i % 3 or None, ["error", "error", "purchase", None, "view"][i % 5], 1.5) for i in range(60)]
            + [(70, "2024-01-04 10:00:00", None, 1, "error", None), (71, "2024-01-04 10:00:00", None, 1, "purchase", None), (71, "2024-01-04 10:00:00", None, 1, "purchase", None), (None, "2024-01-04 10:00:00", None, 1, "view", 2.0), (72, "2024-01-04 10:30:00", None, 1, "error", None), (73, "2024-01-04 10:40:00", None, 1, "error", None), (74, None, None, 1, "error", None), (None, None, None, None, None, None)],
            "click_id long, at string, came string, client_id long, kind string, value double",
        ),
        "region": ([(0, "A"), (1, None), (2, "C")], "r_regionkey int, r_name string"),
        "nation": ([(0, "x", 0), (1, None, 0), (2, "z", None), (None, "y", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (rows, schema) in frames.items():
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at") if name in ("events", "clicks") else df
        if name == "clicks":
            json = ['{"k": 1, "a": [1, "x", null, {"b": 2.5}]}', None, '{"k": "1", "items": [{"sku": 3, "qty": 2}, {"sku": 3}]}', '{"k": ', '{"items": [{"sku": 4, "qty": "x"}, 7]}']
            df = df.withColumn("arrived_at", F.col("came").cast("timestamp_ntz")).drop("came")
            df = df.withColumn("props", F.get(F.array(*map(F.lit, json)), F.pmod("click_id", F.lit(5)).cast("int")))
        df = df.withColumns({c: F.lit("x") for c in ("word", "n", "rank", "s", "id", "h", "key", "tf", "w", "words", "level", "us", "turn", "day", "bucket", "k1", "ask") if c not in df.columns})
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{folder}/none/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_odd_rows_against_sql(spark, odd, name):
    compare(spark, name, odd, "/*.parquet")


@pytest.mark.parametrize("name", list(plans.queries()))
def test_empty_tables(spark, odd, name):
    assert plans.queries()[name](spark, f"{odd}/none").count() == 0


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, FOLDER, "")


def compare(spark, name, folder, files):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
    got = plans.queries()[name](spark, folder)
    found = con.sql(plans.oracle_sql()[name])
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(got.columns) == sorted(found.columns)
    assert normal([r.asDict() for r in got.collect()], got.columns) == normal(want, got.columns)


def test_page_markdown_by_hand(spark):
    html = '<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><nav><li>x</li></nav><div class="ad">buy</div><h1>A</h1><p><b>one<br>two &amp;amp;</p><!-- c --><footer>f</footer>'
    row = capture.page_markdown(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).head()
    assert row["title"] == "A & B"
    assert row["markdown"] == "# A\none\ntwo &amp;"


def test_threads_and_pairs(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    assert capture.thread_markdown(df).head()["markdown"] == "**user**: a\n\n**assistant**: b\n\n**user**: c"
    assert {(r.question, r.answer) for r in capture.qa_pairs(df).collect()} == {("a", "b"), ("c", None)}


def test_english_function_words(spark):
    """A corpus too small to show Chinese words keeps all of their characters."""
    df = spark.createDataFrame([(1, "zh", "我们的城市，和平与发展"), (2, "en", "The cat is on a mat"), (3, None, "the cat"), (5, "ja", "和平と発展の")], "doc_id long, lang string, text string")
    got = {r.doc_id: r.compressed for r in compress.strip_function_words(df).collect()}
    assert got == {1: "我们的城市 和平与发展", 2: "cat mat", 3: "the cat", 5: "和平と発展の"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from([*FUNCTION_WORDS["en"], "stone", "river"]), max_size=12))
def test_compression_is_idempotent(spark, words):
    df = spark.createDataFrame([(1, "en", " ".join(words))], "doc_id long, lang string, text string")
    once = compress.strip_function_words(df)
    twice = compress.strip_function_words(once.select("doc_id", "lang", F.col("compressed").alias("text")))
    assert once.head()["compressed"] == twice.head()["compressed"]


def test_report_has_every_claim(spark):
    claims = spark.createDataFrame([(1, "a b c d e f g h"), (2, "no such words stand here at all"), (3, "b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "s", "x a b c d e f g h y"), (2, "t", "b c d e f"), (3, "t", None)], "doc_id long, source string, text string")
    got = {r.item_id: (r.n_docs, r.support) for r in check.check_report(claims, docs).collect()}
    assert got == {1: (2, "verbatim"), 2: (0, "none_found"), 3: (0, "verbatim")}


def test_short_claims_meet_by_their_inner_words(spark):
    """Every length of claim, cut within words at both ends, against a plain search."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    whole = " ".join(words)
    cuts = sorted({whole[i:j] for i in (0, 2, 6, 7) for j in range(i + 1, len(whole) + 1, 3)} | {"nothing of this", "gamma beta alpha"})
    claims = spark.createDataFrame(list(enumerate(cuts)), "item_id long, text string")
    texts = [whole, f"x{whole}x", " ".join(words[:5]), "gamma, delta", None, whole.upper()]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    want = {(i, d) for i, c in enumerate(cuts) for d, t in enumerate(texts) if t and c in t}
    got = [(r.item_id, r.doc_id) for r in check.containing(claims, docs).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_duplicates_and_links(spark):
    words = [f"w{chr(97 + i)}" for i in range(26)]
    texts = [" ".join(words), " ".join([*words[:25], "zz"]), " ".join(words), "other text of some more words here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [(r.a, r.b) for r in digest.near_duplicates(docs).collect()] == [(0, 1)]
    short = spark.createDataFrame([(1, "en", "stone river", 11), (2, "en", "river stone hill", 16), (3, "en", "hill", 4)], "doc_id long, lang string, text string, n_chars long")
    assert [tuple(r) for r in knowledge.fragment_links(short).collect()] == [(2, 1, 2, False)]


def test_near_duplicate_members(spark):
    """Copies, and texts that differ in case, digits and punctuation, are found again; texts without a shingle are in no class."""
    texts = ["one two three four five six", "other words of a longer text here", "One, two, three 3 four five six!", "one two three four five six", "too short", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r) for r in digest.near_duplicate_members(docs).collect()) == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_near_duplicates_against_brute_force(spark):
    """A passage that all documents share, families just above and below the limit, repeated shingles."""
    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    shared = [word() for _ in range(60)]
    for _ in range(60):
        texts.append([word() for _ in range(rng.randint(5, 60))] + shared)
    for size in (12, 40, 150):
        base = [word() for _ in range(size)]
        for _ in range(20):
            texts.append([word() if rng.random() < rng.choice([0.0, 0.005, 0.02]) else w for w in base] + rng.choice([[], shared, base[:5]]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(tuple(t[k : k + 5]) for k in range(len(t) - 4)), i)
    reps, want = [(i, s) for s, i in sets.items() if s], {}
    for i, s in reps:
        for j, t in reps:
            if i < j and len(s & t) / len(s | t) >= 0.75:
                want[i, j] = round(len(s & t) / len(s | t), 6)
    assert len(want) > 20
    assert {(r.a, r.b): r.jaccard for r in digest.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("most", [3, 256])
def test_every_fragment_link(spark, most):
    """All pairs by brute force, those of one class included, with a pair of keywords that most fragments hold."""
    rng, pool = random.Random(3), ["river", "stone", "hill", "lake", "wood", "field"]
    texts = {i: ["river", "stone", *rng.sample(pool, rng.randint(0, 3))] if i % 3 else rng.sample(pool, rng.randint(1, 4)) for i in range(40)}
    short = spark.createDataFrame([(i, "en", " ".join(t), 50) for i, t in texts.items()], "doc_id long, lang string, text string, n_chars long")
    rows = knowledge.fragment_links(short, most).collect()
    sets = {i: set(t) for i, t in texts.items()}
    rep = {r.doc_id: r.linked_doc for r in rows if r.same_set}
    linked = {(r.doc_id, r.linked_doc): r.n_shared for r in rows if not r.same_set}
    assert len(rep) + len(linked) == len(rows) and rep and linked
    for i in sets:
        for j in range(i):
            a, b, n = rep.get(i, i), rep.get(j, j), len(sets[i] & sets[j])
            got = len(sets[i]) if a == b else linked.get((max(a, b), min(a, b)), 0)
            assert got == (n if n > 1 else 0)
            assert (a == b) == (sets[i] == sets[j] and n > 1)
    counts = {r.doc_id: (r.class_id, r.n_links) for r in knowledge.fragment_link_counts(short).collect()}
    assert counts == {i: (rep.get(i, i), sum(len(s & t) > 1 for j, t in sets.items() if j != i)) for i, s in sets.items() if len(s) > 1}


def test_mermaid_quotes_labels(spark):
    pages = spark.createDataFrame([(1, "u", '<a href="/a,b">a,b</a>')], "page_id long, url string, html string")
    assert graph.links_mermaid(pages).head()["mermaid"] == 'graph LR\n  p["u"]\n  p --> n0["/a,b"]'


def test_daily_activity_stream(spark, tmp_path):
    from basalt.streaming import daily_activity

    src = str(tmp_path / "in")
    spark.read.parquet(f"{FOLDER}/events.parquet").select("ts", "event_type").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(src)
    q = daily_activity(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).head()[0] == 1000


def test_markdown_is_written_and_read_again(spark, tmp_path):
    """The text sink against the lines of what was written."""
    from basalt.sources import table, write_markdown

    whole = capture.thread_markdown(table(spark, FOLDER, "conversations"))
    want = sorted(line for r in whole.collect() for line in r.markdown.split("\n"))
    write_markdown(whole, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == want
