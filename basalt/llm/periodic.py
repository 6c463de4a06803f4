"""Runs of periodically repeated words, by partition refinement.

Positions of a text are classed by the factor (stretch of words) that begins there, for lengths 1, 2, 3 and on. Classes of one length are
refined into those of the next by looking one place to the left of the classes that were split off last, of which, for
each class split, the largest part may be left out: a position is thus moved at most log n times. Neighbours in a class of length l
that stand l apart begin a square of period l; squares at following positions are one run. A factor of a primitive square's root
has no other place within the square, so squares of a period that isn't the smallest don't show.

Before that, arrays narrow a text down: a run of at least ``least`` words and three periods holds, from its first word to its last, stretches of
``least`` * 2 // 3 words that the text repeats, so only words covered by such stretches are refined. They are found by a hash of each stretch, for
many texts at once; a collision costs time, and loses nothing. Texts without such a stretch, which most are, end there.

Each text is worked on in the task that reads it, without a shuffle; texts are taken together up to ``WORDS`` words, a longer one alone.

Defined cases: null and empty texts, and texts of fewer than ``least`` words, have no run; texts and words of any length are taken whole; rows that repeat an
identifier are rows of their own; a null identifier stays; an empty table gives an empty result; only the identifier is carried along.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

LEAST = 24
#: Words that are narrowed down at a time.
WORDS = 1 << 20
WORD = re.compile(common.WORD_RE)
BASE = 0x9E3779B97F4A7C15


def squares(s: list[int]):
    """(period, starts of squares of that period) of primitive squares of a sequence of numbers, by ascending period."""
    n = len(s)
    nxt, prv, cls = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    head, size, first = [], [], {}
    gaps: dict[int, list[int]] = {}
    last: list[int] = []
    for i, x in enumerate(s):
        c = first.setdefault(x, len(head))
        cls[i] = c
        if c == len(head):
            head.append(i)
            size.append(1)
            last.append(i)
        else:
            t = last[c]
            nxt[t], prv[i], last[c] = i, t, i
            size[c] += 1
            gaps.setdefault(i - t, []).append(t)
    # the end is a factor of its own, so what reaches beyond it is alone in its class
    cls[n] = len(head)
    head.append(n)
    size.append(1)

    def members(c):
        found, i = [], head[c]
        while i >= 0:
            found.append(i)
            i = nxt[i]
        return found

    largest = max(range(len(head)), key=size.__getitem__)
    small = [members(c) for c in range(len(head)) if c != largest]
    length = 1
    while True:
        starts = sorted({i for i in gaps.pop(length, ()) if nxt[i] == i + length})
        if starts:
            yield length, starts
        if not small:
            return
        split: dict[int, list[tuple[int, list[int]]]] = {}
        for some in small:
            new: dict[int, list[int]] = {}
            for i in some:
                p = i - 1
                if p < 0:
                    continue
                d = cls[p]
                if size[d] == 1 and d not in new:
                    continue
                a, b = prv[p], nxt[p]
                if a >= 0:
                    nxt[a] = b
                else:
                    head[d] = b
                if b >= 0:
                    prv[b] = a
                    if a >= 0 and b - a > length:
                        gaps.setdefault(b - a, []).append(a)
                size[d] -= 1
                moved = new.get(d)
                if moved is None:
                    new[d] = [p]
                    prv[p] = -1
                else:
                    t = moved[-1]
                    nxt[t], prv[p] = p, t
                    if p - t > length:
                        gaps.setdefault(p - t, []).append(t)
                    moved.append(p)
                nxt[p] = -1
                cls[p] = -1 - d  # in no class that another stretch could take it from
            for d, moved in new.items():
                c = len(head)
                head.append(moved[0])
                size.append(len(moved))
                for p in moved:
                    cls[p] = c
                split.setdefault(d, []).append((c, moved))
        small = []
        for d, parts in split.items():
            if size[d] > 0:
                parts.append((d, None))
            if len(parts) > 1:
                keep = max(parts, key=lambda x: size[x[0]])[0]
                small += [moved if moved is not None else members(c) for c, moved in parts if c != keep]
        length += 1


def runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` places and three periods."""
    found = []
    for period, starts in squares(s):
        begin = 0
        for k in range(1, len(starts) + 1):
            if k == len(starts) or starts[k] != starts[k - 1] + 1:
                length = starts[k - 1] - starts[begin] + 2 * period
                if length >= max(least, 3 * period):
                    found.append((starts[begin], length, period))
                begin = k
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which places are covered by a stretch of ``width`` that its text (``owner``) holds twice, by hash."""
    n = len(ids)
    covered = np.zeros(n, dtype=bool)
    if n < width:
        return covered
    h = mix(ids.astype(np.uint64) * np.uint64(2) + np.uint64(1)) ^ mix(owner.astype(np.uint64) + np.uint64(BASE))
    total, size, power, done, rest = None, 1, np.uint64(BASE | 1), 0, width
    while rest:  # the stretch as powers of two, each made of two halves
        if rest & 1:
            part = h[done : done + n - width + 1]
            total = part if total is None else total * power + part
            done += size
        if rest > 1:
            h = h[:-size] * power + h[size:]
        rest >>= 1
        size *= 2
        power = power * power
    whole = owner[: n - width + 1] == owner[width - 1 :]
    at = np.flatnonzero(whole)
    order = np.argsort(total[at], kind="stable")
    same = total[at][order][1:] == total[at][order][:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(texts: list[list[str]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0] if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        covered = repeated(ids, owner, least * 2 // 3)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t in np.unique(owner[covered]):
        here = covered[begins[t] : begins[t + 1]].astype(np.int8)
        step = np.diff(here, prepend=0, append=0)
        froms, tos = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # stretches of the text one after another, with a number between them that occurs once
        numbers, places = [], []
        for k, (a, b) in enumerate(zip(froms.tolist(), tos.tolist(), strict=True)):
            numbers += ids[begins[t] + a : begins[t] + b].tolist()
            numbers.append(-1 - k)
            places.append(np.arange(a, b + 1))
        place = np.concatenate(places)
        found[t] = [(int(place[start]), length, period) for start, length, period in runs(numbers, least)]
    return found


def kept_words(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if not n]


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and collapsed: the words that no run repeats, joined by a blank."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in batches:
            id_type, texts = b.schema.field("doc_id").type, b.column("text")
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and (not some or size < WORDS):
                    some.append(WORD.findall(texts[at + len(some)].as_py()))
                    size += len(some[-1])
                found = runs_of(some, least)
                shown = [[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found]
                joined = [" ".join(kept_words(w, f)) for w, f in zip(some, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(some)).cast(id_type), pa.array(shown, pa.list_(item)), pa.array(joined, pa.string())], names=["doc_id", "runs", "collapsed"])
                at += len(some)

    return rows.mapInArrow(work, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def best_run(runs: F.Column) -> F.Column:
    """The run of greatest length to period, by comparison of products; of equal ones the first by start, then period. Null without a run."""
    better = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), lambda a, x: F.when(better(a, x), x).otherwise(a)))
