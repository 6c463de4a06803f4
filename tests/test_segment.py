import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import compress, segment

#: Words of which the Chinese texts below are made; 和, 的 and 了 stand alone and within words.
NOUNS = "城市 和平 目的 经济 国家 学校 成就 工作 历史 老师 问题 文化 河流 森林 桥梁 音乐 电影 数学 医院 道路 商店 报纸 邻居 朋友 天气 海洋 农民 机器 语言 图书".split()
VERBS = "发展 了解 研究 支持 讨论 记录 保护 描写 寻找 改变 建造 访问".split()


@pytest.fixture(scope="module")
def chinese():
    rng = random.Random(1)
    made = []
    for _ in range(1500):
        a, b, c = rng.sample(NOUNS, 3)
        v = rng.choice(VERBS)
        made.append(rng.choice([f"{a}的{b}{v}{c}", f"{a}和{b}{v}{c}", f"我们{v}{a}和{b}的{c}", f"{a}{v}了{b}", f"他{v}{b}", f"{a}{v}{b}和{c}", f"她{v}{a}的{c}"]))
    return made


def plain_lexicon(counts, longest=4):
    """Word: (weight, cohesion, freedom), by dictionaries."""
    grams, before, after = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for run, n in counts.items():
        padded = f"^{run}$"
        for i in range(1, len(padded) - 1):
            for k in range(1, longest + 1):
                if i + k < len(padded):
                    w = padded[i : i + k]
                    grams[w] += n
                    before[w][padded[i - 1]] += n
                    after[w][padded[i + k]] += n
    total = sum(n for w, n in grams.items() if len(w) == 1)
    entropy = lambda c: round(math.log(sum(c.values())) - sum(n * math.log(n) for n in c.values()) / sum(c.values()), 6)
    found = {}
    for w, n in grams.items():
        cohesion = round(min(math.log(n * total / (grams[w[:s]] * grams[w[s:]])) for s in range(1, len(w))), 6) if len(w) > 1 else None
        freedom = min(entropy(before[w]), entropy(after[w]))
        if len(w) == 1 or (n >= segment.LEAST and cohesion >= segment.COHESION and freedom >= segment.FREEDOM):
            found[w] = round(math.log(n / total), 6), cohesion, freedom
    return found


def viterbi(run, weights, longest=4):
    """Best series of words; of equal ones the longer first word."""
    best = [(0.0, [])]
    for i in range(len(run) - 1, -1, -1):
        ways = [(weights[run[i : i + k]] + best[k - 1][0], k) for k in range(1, min(longest, len(run) - i) + 1) if run[i : i + k] in weights]
        score, k = max(ways)
        best.insert(0, (score, [run[i : i + k], *best[k - 1][1]]))
    return best[0][1]


def test_lexicon_and_paths_against_plain_code(spark, chinese):
    docs = spark.createDataFrame([(t,) for t in chinese], "text string")
    runs = segment.stretch_counts(docs, segment.HAN).cache()
    counts = {r.run: r.n for r in runs.collect()}
    assert counts == collections.Counter(chinese)
    want = plain_lexicon(counts)
    lexicon = segment.lexicon(runs)
    got = {r.word: (r.weight, r.cohesion, r.freedom) for r in lexicon.collect()}
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w], abs=2e-6) for w in want if len(w) > 1)
    assert set(NOUNS + VERBS) <= set(got)  # all words are found
    weights = {w: x[0] for w, x in got.items()}
    for r in segment.segmented(runs.select("run"), lexicon).collect():
        assert list(r.words) == viterbi(r.run, weights), r.run


def test_function_words_go_unless_within_words(spark, chinese):
    """和, 的, 了 go where they stand alone, and stay in 和平, 目的, 了解; no list of such words is given."""
    more = ["和平的目的", "我们了解和平和文化", "abc城市的def x"]
    rows = [(i, "zh", t) for i, t in enumerate(chinese + more)] + [(9000, "zh", "no Han, 1 的"), (9001, "en", "the 城市的 cat"), (9002, None, "城市的"), (9003, "zh", None), (9004, "zh", "。，")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit("x") for c in ("id", "p", "run", "word", "n", "kept")})
    got = {r.doc_id: r.compressed for r in compress.strip_function_words(docs).collect()}
    assert len(got) == len(rows)
    assert [got[len(chinese) + k] for k in range(3)] == ["和平目的", "我们了解和平文化", "abc城市def x"]
    assert [got[k] for k in (9000, 9001, 9002, 9003, 9004)] == ["no han", "城市的 cat", "城市的", None, ""]
    right = 0
    for i, t in enumerate(chinese):
        bare = viterbi(t, {w: 1.0 if len(w) > 1 else 0.0 for w in [*NOUNS, *VERBS, "我们", *t]})
        right += got[i] == "".join(w for w in bare if w not in ("和", "的", "了"))
    assert right > 0.95 * len(chinese)
    stats = {r.lang: (r.n_docs, r.chars_before, r.chars_after) for r in compress.compression_stats(docs).collect()}
    assert stats["zh"][0] == len(chinese) + 6 and stats["zh"][2] == sum(len(x) for i, x in got.items() if i not in (9001, 9002) and x)


def test_long_runs_and_many_bytes(spark):
    """A run beyond a stretch, letters beyond the first plane, one letter, nothing."""
    rows = [("x" * 1000,), ("𝔸𝔹" * 10,), ("a",), ("",), (None,), ("ab " * 5,)]
    df = spark.createDataFrame(rows, "text string")
    got = {r.run: (r.n, r.pieces) for r in segment.word_pieces(df).collect()}
    assert sum(len(k) * n for k, (n, _) in got.items()) == 1000 + 20 + 1 + 10
    assert all(p.replace(" ", "") == run for run, (_, p) in got.items())
    assert segment.word_pieces(df.limit(0)).count() == 0 and segment.found_words(df.limit(0)).count() == 0


def test_cells_meet_without_another_shuffle(spark):
    """The cells of a run, four a letter, are not sent once more: one exchange by run, before they are spread."""
    runs = spark.createDataFrame([("abab",), ("b",), ("𝔸b𝔸",)], "run string")
    words = spark.createDataFrame([("a", -1.0), ("b", -1.0), ("ab", -0.5), ("𝔸", -1.0), ("b𝔸", -0.5)], "word string, weight double")
    out = segment.segmented(runs, words)
    assert {r.run: list(r.words) for r in out.collect()} == {"abab": ["ab", "ab"], "b": ["b"], "𝔸b𝔸": ["𝔸", "b𝔸"]}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
