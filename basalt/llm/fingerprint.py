"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are cut by its content: behind a line end, and behind each four code points whose hash is one of a sixteenth of all; so
they are the same wherever a passage stands, in any script, with blanks or without. Where nothing cuts for ``MOST`` code points, these are one. They are hashed; a paragraph that occurs again gets a
digest of its own, so a text is a set of digests. Each digest goes to three cells, one in each third of the table;
a cell holds a count, the xor of its digests and the xor of their checks. Two versions' cells subtract, and
peeling cells that hold one digest recovers the digests that differ; if cells stay, both sides are sketched again
four times larger, as often as it takes. A sixteenth of the digests, compared directly, tells the size to begin with.
The likeness is the share of the digests of both that they have in common, so a text that shares half of itself with one of equal length is alike by about a half. Many pairs are sketched and peeled at once, each in its own stretch of one array.

To meet its neighbour, a document must stand next to it without a sort of the corpus in one task: identifiers
are split at approximate quantiles, each part is one partition, sorted by itself, and the first document of each part is also
sent to the part before it (the first of all to the last), so each text is shuffled once and a task holds a few
documents at a time. There are twice as many parts as shuffle partitions, so their size follows that setting; the driver sees one
identifier a part. An identifier that fills several quantiles is split into as many parts, by the order of its rows.

Defined cases: null and empty text has no paragraph, and two of those are alike by 1; a null identifier counts as
the smallest; rows that repeat an identifier follow one another by a hash of their text and of the input partition they come
from, so that copies of one row split too; a single row is its own
neighbour; an empty table gives an empty result; only the identifier is carried along.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

SMALLEST = 18
#: Cells and code points that a task handles at a time.
CELLS = 1 << 19
CHARS = 4 << 20
#: Code points that decide on a cut, and the most that a paragraph holds.
CONTEXT = 4
MOST = 64
NO_ID = -9223372036854775808
C3 = np.uint64(0x9E3779B97F4A7C15)
SAMPLED = np.uint64(1 << 60)  # a sixteenth of the digests
TURNS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def begins(codes: np.ndarray) -> np.ndarray:
    """Where the paragraphs of a text, given as code points, begin."""
    n = len(codes)
    cut = codes == 10
    if n >= CONTEXT:
        h = np.zeros(n - CONTEXT + 1, np.uint64)
        for k in range(CONTEXT):
            h = h * TURNS[0] + codes[k : n - CONTEXT + 1 + k]
        h ^= h >> np.uint64(29)
        cut[CONTEXT - 1 :] |= (h * TURNS[1]) >> np.uint64(60) == 0
    starts = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    lengths = np.diff(np.append(starts, n))
    if (lengths > MOST).any():
        parts = -(-lengths // MOST)
        first = np.cumsum(parts) - parts
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * MOST
    return starts


def digests(text: str) -> np.ndarray:
    """A set of 64-bit digests; the n-th copy of a paragraph differs from the first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return codes
    starts = begins(codes)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    # each code point is scrambled together with its place in the paragraph, and these add up
    found = np.add.reduceat(mix((codes + np.uint64(1)) * C3 + place.astype(np.uint64) * TURNS[2]), starts)
    found.sort()
    first = np.concatenate([[True], found[1:] != found[:-1]])
    if first.all():
        return mix(found)
    at = np.arange(len(found))
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.unique(mix(found + nth * C3))


def cells(keys: np.ndarray, size: int) -> np.ndarray:
    third = np.uint64(size // 3)
    return np.concatenate([(mix(keys * t) % third).astype(np.int64) + i * (size // 3) for i, t in enumerate(TURNS)])


def tables(sets: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, xors of digests and xors of checks, ``size`` cells a set."""
    keys = np.concatenate([np.zeros(0, np.uint64), *sets])
    at = cells(keys, size) + np.tile(np.repeat(np.arange(len(sets)) * size, [len(s) for s in sets]), 3)
    count, key, check = np.bincount(at, minlength=size * len(sets)), np.zeros(size * len(sets), np.uint64), np.zeros(size * len(sets), np.uint64)
    np.bitwise_xor.at(key, at, np.tile(keys, 3))
    np.bitwise_xor.at(check, at, np.tile(mix(keys ^ C3), 3))
    return count, key, check


def texts_of(sets: list[np.ndarray]) -> list[str]:
    """A fingerprint of each set: its number of digests and the cells of the smallest size."""
    count, key, check = (x.reshape(len(sets), SMALLEST) for x in tables(sets, SMALLEST))
    count, key, check = count.astype("<u4"), key.astype("<u8"), (check & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [base64.b64encode(np.uint32(len(s)).tobytes() + count[i].tobytes() + key[i].tobytes() + check[i].tobytes()).decode() for i, s in enumerate(sets)]


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From subtracted tables, one after another: number of the pair, digest and sign (1: the first text's alone, -1: the second's) of what was recovered; which pairs have cells left."""
    empty, found = np.zeros(0, np.int64), []
    count, key, check = count.copy(), key.copy(), check.copy()
    while True:
        one = np.flatnonzero(np.abs(count) == 1)
        one = one[mix(key[one] ^ C3) == check[one]]
        if not len(one):
            break
        pair, keys = one // size, key[one]
        order = np.lexsort((keys, pair))
        pair, keys, signs = pair[order], keys[order], count[one][order]
        first = np.concatenate([[True], (pair[1:] != pair[:-1]) | (keys[1:] != keys[:-1])])
        pair, keys, signs = pair[first], keys[first], signs[first]
        found.append((pair, keys, signs))
        where = cells(keys, size) + np.tile(pair * size, 3)
        np.subtract.at(count, where, np.tile(signs, 3))
        np.bitwise_xor.at(key, where, np.tile(keys, 3))
        np.bitwise_xor.at(check, where, np.tile(mix(keys ^ C3), 3))
    left = ((count != 0) | (key != 0) | (check != 0)).reshape(-1, size).any(axis=1)
    return (*(np.concatenate([empty.astype(t), *(x[k] for x in found)]) for k, t in enumerate((np.int64, np.uint64, np.int64))), left)


def first_size(a: np.ndarray, b: np.ndarray) -> int:
    """Cells that the digests of a sixteenth and the numbers of all let expect to suffice."""
    size, likely = SMALLEST, max(abs(len(a) - len(b)), 16 * len(np.setxor1d(a[: np.searchsorted(a, SAMPLED)], b[: np.searchsorted(b, SAMPLED)], assume_unique=True)))
    while likely > 0.7 * size:
        size *= 4
    return size


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For pairs of sets: digests of the first and of the second alone, and the size of the sketches that gave them."""
    out: list = [None] * len(pairs)
    wait: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(pairs):
        wait.setdefault(first_size(a, b), []).append(i)
    while wait:
        size = min(wait)
        every, step = wait.pop(size), max(1, CELLS // size)
        for some in (every[k : k + step] for k in range(0, len(every), step)):
            x, y = tables([pairs[i][0] for i in some], size), tables([pairs[i][1] for i in some], size)
            pair, keys, signs, left = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2], size)
            order = np.argsort(pair, kind="stable")
            bounds = np.searchsorted(pair[order], np.arange(len(some) + 1))
            for k, i in enumerate(some):
                if left[k]:
                    wait.setdefault(4 * size, []).append(i)
                else:
                    at = order[bounds[k] : bounds[k + 1]]
                    out[i] = keys[at[signs[at] > 0]], keys[at[signs[at] < 0]], size
    return out


def likeness(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Twice the common digests by the digests of both."""
    common_ones = len(a) - len(left)
    every = len(a) + common_ones + len(right)
    return 2 * common_ones / every if every else 1.0


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def below(value: F.Column, bounds: list[int]) -> F.Column:
    """How many of the ascending ``bounds`` are less than the value, by halving."""
    if not bounds:
        return F.lit(0)
    given, top = F.array(*map(F.lit, bounds)), len(bounds).bit_length() - 1
    steps = F.array(*[F.lit(1 << k) for k in range(top, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(given, at + step - 1) < value, at + step).otherwise(at))


def with_neighbour(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, part, flag in partitions sorted so that a part's rows follow one another, flag 1 being the next part's first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), common.body(F.col(text_col)).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text", F.spark_partition_id()))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 4 * parts).alias("b")).head()["b"] or []
    # of the bounds that equal an identifier, each begins a part of its rows, by their order
    below_id = below(F.col("id"), bounds)
    equal = F.when(F.col("id") == F.lit(9223372036854775807), F.lit(len(bounds))).otherwise(below(F.col("id") + 1, bounds)) - below_id
    share = F.least(F.lit(1.0 - 1e-9), F.col("order").cast("double") / 2.0**64 + 0.5)
    part = (below_id + F.floor(share * (equal + 1))).cast("int")
    firsts = sorted((r["part"], r["at"]["id"], r["at"]["order"]) for r in rows.groupBy(part.alias("part")).agg(F.min(F.struct("id", "order")).alias("at")).collect())
    before = [(i, o, firsts[k - 1][0]) for k, (_, i, o) in enumerate(firsts)]
    sent = F.broadcast(spark.createDataFrame(before, "first long, first_order long, prior int"))  # a row a part
    placed = rows.withColumn("part", part).join(sent, (F.col("id") == F.col("first")) & (F.col("order") == F.col("first_order")), "left")
    own, also = F.struct(F.col("part").alias("part"), F.lit(0).alias("flag")), F.struct(F.col("prior").alias("part"), F.lit(1).alias("flag"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("prior").isNull(), F.array(own)).otherwise(F.array(own, also))))
    placed = placed.select("doc_id", "id", "text", "at.part", "at.flag", "order")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "flag", "id", "order").select("doc_id", "text", "part", "flag")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    common.small_batches(docs.sparkSession, 200)
    rows = with_neighbour(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(waiting, id_type):
        """The result of rows of identifier, number of code points, edited text's sum, digests of text, edited and next text."""
        docs, n, sums, own, changed, following = zip(*waiting, strict=True)
        prints = texts_of([*own, *changed])
        found = differences([*zip(own, changed, strict=True), *zip(own, following, strict=True)])
        near = [likeness(a, left, right) for a, (left, right, _) in zip([*own, *own], found, strict=True)]
        cols = [docs, n, sums, prints[: len(own)], prints[len(own) :], near[: len(own)], near[len(own) :]]
        return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, types, strict=True)], names=names)

    def work(batches):
        held = None  # the row that waits for its neighbour
        for b in batches:
            id_type, waiting, size = b.schema.field("doc_id").type, [], 0
            for doc, text, flag in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "flag")), strict=True):
                own = (doc, text, digests(text)) if held is not None or not flag else None
                if held is not None:
                    edited = edit(held[1], text)
                    waiting.append((held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), held[2], digests(edited), own[2]))
                    size += len(edited)
                    if size > CHARS:
                        yield compared(waiting, id_type)
                        waiting, size = [], 0
                held = None if flag else own
            if waiting:
                yield compared(waiting, id_type)

    return rows.mapInArrow(work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
