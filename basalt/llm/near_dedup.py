"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

Sets. A text's set is its distinct five-word shingles, each a 64-bit hash over hashed words. Documents of equal sets
(by a 128-bit digest of the set) form a class, represented by its smallest identifier; only representatives go on.

Signatures. A permutation's hash range is cut into bins, each keeps its smallest hash, and an empty bin borrows
from a bin that its own sequence of hashes meets first (optimal densification). Sets of ``SMALL`` shingles and more
use 8 permutations of 16 bins, sets below ``SMALL`` / 0.75 use 32 of 4 bins, so that few bins stay empty; in between
both. Either way four values make a band and 32 bands a signature: a pair at 0.75 shares no band with a chance
of (1 - 0.75^4)^32, about 5 in a million.

Candidates. In each bucket the member that shares most buckets is the centre, and only its edges to the members are
candidates, so pairs grow with members, not with their square; each member is first confirmed against its best
centre. In buckets that then still hold several components, members of different components are weighed in
memory, block against block of ``BLOCK`` members, by ``VALUES`` further one-permutation values each, and only pairs
that agree in ``LIKELY`` of them are candidates (at a similarity of 0.75 fewer agree with a chance of about one
in a million). So no pair within a group is emitted unless it is about to be a link, and no link is lost to the
choice of centres.

Confirmation. Both texts' full sets are built again and compared. A centre with many members is dealt to several
tasks of ``SPREAD`` members with a copy of its set each. Links become components by alternating
large-star and small-star steps on DataFrames; neither links nor components reach the driver.

Defined cases: null text and text without words have the empty set and stand alone; rows that repeat an identifier are
one node with each of its texts; a row without identifier stands alone with a null component, and stays; an empty
table gives an empty result; only the identifier is carried along.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

WORDS = 5
SMALL = 48
SPREAD = 256
BLOCK = 8192
VALUES = 512
LIKELY = 0.66
CHUNK = 1 << 20
#: A word of more bytes counts as a digest of it.
LONG_WORD = 4096
LONGER = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (LONG_WORD + 1))
SPLIT = re.compile(rb"[\x20\x09-\x0D]")
SALTS = 16
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
FOLDED = FOLD.tobytes()
SPACE = np.array([c in b"\x20\t\n\x0b\x0c\r" for c in range(256)])
K3 = np.uint64(0x9E3779B97F4A7C15)


@cache
def randoms(n: int, salt: int) -> np.ndarray:
    """Odd numbers to multiply with."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * K3 + np.uint64(salt)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Short texts go several at a time, longer ones in segments of about CHUNK bytes."""
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        if len(t) > LONG_WORD:
            # no text in UTF-8 holds the byte 255
            t = LONGER.sub(lambda m: b"\xff" + hashlib.blake2b(m.group().translate(FOLDED), digest_size=32).hexdigest().encode(), t)
        if len(t) > CHUNK:
            out += _sets(part)
            part, size = [], 0
            every = np.concatenate([word_hashes([s])[0] for s in segments(t)])
            out.append(_set(every, _shingles(every)))
            continue
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            out += _sets(part)
            part, size = [], 0
    return out + _sets(part)


def segments(text: bytes):
    """Pieces of about CHUNK bytes, cut at white space."""
    at = 0
    while at < len(text):
        m = SPLIT.search(text, at + CHUNK)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's begin, with their number at the end."""
    raw = FOLD[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = SPACE[raw]
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    lengths = ends - starts
    chars = raw[~space].astype(np.uint64) + np.uint64(1)
    word_at = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(word_at, lengths)
    words = mix(np.add.reduceat(chars * randoms(LONG_WORD, 11)[place], word_at) + lengths.astype(np.uint64) * K3)
    return words, np.searchsorted(starts, begins)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words."""
    times = randoms(WORDS, 12)
    every = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        every += words[k : k + len(every)] * times[k]
    return mix(every)


def _set(words: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The set of a text of these words, ``every`` being its runs."""
    if len(words) >= WORDS:
        s = np.sort(every)
        return s[np.concatenate([[True], s[1:] != s[:-1]])]
    if len(words):
        return mix((words * randoms(WORDS, 12)[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    return np.zeros(0, np.uint64)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    words, first = word_hashes(texts)
    every = _shingles(words)
    return [_set(words[a:b], every[a : max(a, b - WORDS + 1)]) for a, b in zip(first[:-1], first[1:], strict=True)]


def one_permutation(s: np.ndarray, reps: int, bins: int) -> np.ndarray:
    """reps x bins smallest hashes, densified."""
    h = np.sort(mix(s[None, :] * randoms(reps, 13)[:, None] + randoms(reps, 14)[:, None]), axis=1)
    shift = np.uint64(64 - bins.bit_length() + 1)
    group = ((h >> shift).astype(np.int64) + np.arange(reps)[:, None] * bins).ravel()
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    values, full = np.zeros(reps * bins, np.uint64), np.zeros(reps * bins, bool)
    values[group[at]] = h.ravel()[at]
    full[group[at]] = True
    if not full.all():
        lacks, turn = np.flatnonzero(~full), 0
        own, filled = values.copy(), full
        while len(lacks):
            turn += 1
            step = mix((lacks % bins).astype(np.uint64) * K3 + np.uint64(turn)) % np.uint64(bins)
            source = lacks // bins * bins + step.astype(np.int64)
            good = filled[source]
            values[lacks[good]] = own[source[good]]
            lacks = lacks[~good]
    return values.reshape(reps, bins)


def bands(values: np.ndarray, tag: int) -> np.ndarray:
    rows = values.reshape(-1, 4)
    n = len(rows)
    return mix((rows * randoms(4, 15)[None, :]).sum(axis=1, dtype=np.uint64) + randoms(n, 16 + tag)).view(np.int64)


def signature(s: np.ndarray) -> list[int]:
    """Bucket keys."""
    keys = []
    if len(s) >= SMALL:
        keys += bands(one_permutation(s, 8, 16), 0).tolist()
    if len(s) and len(s) * 3 < SMALL * 4:
        keys += bands(one_permutation(s, 32, 4), 1).tolist()
    return keys


def sketch(s: np.ndarray) -> bytes:
    """A byte of each of VALUES values in the form for large sets, then in that for small ones; zeros for a form not used."""
    low = lambda v: (v & np.uint64(255)).astype(np.uint8).tobytes()
    large = low(one_permutation(s, VALUES // 32, 32)) if len(s) >= SMALL else bytes(VALUES)
    small = low(one_permutation(s, VALUES // 4, 4)) if len(s) * 3 < SMALL * 4 else b""
    return large + small


def signatures(rows: DataFrame) -> DataFrame:
    """doc, n, digest (null for the empty set), keys from rows of doc, text."""
    names = ["doc", "n", "digest", "keys"]

    def work(batches):
        for b in batches:
            sets = shingle_sets([t.encode() for t in b.column("text").to_pylist()])
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([signature(s) for s in sets], pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(work, "doc long, n long, digest binary, keys array<long>")


def likely_pairs(key: int, group: list[tuple[int, int, int, int, bytes, list[int]]]) -> set[tuple[int, int]]:
    """Pairs of different components that may be links, from rows of side, doc, n, comp, sketch, keys of two blocks.

    Side 0 and 1 are two blocks, compared with one another; with side 0 alone, a block with itself. A pair
    belongs to the smallest key that both have, and only that bucket gives it.
    """
    keys: dict[int, frozenset] = {}

    def own_keys(i: int) -> frozenset:
        if i not in keys:
            keys[i] = frozenset(group[i][5])
        return keys[i]

    side, doc, n, comp = (np.array([r[k] for r in group], dtype=np.int64) for k in range(4))
    found: set[tuple[int, int]] = set()
    two = side.any()
    for form in (0, 1):
        has = n >= SMALL if form == 0 else 3 * n < 4 * SMALL
        x, y = np.flatnonzero(has & (side == 0)), np.flatnonzero(has & (side == (1 if two else 0)))
        if not len(x) or not len(y):
            continue
        least = VALUES * (LIKELY if form == 0 else 0.5)
        values = lambda at: np.frombuffer(b"".join(group[i][4][form * VALUES : (form + 1) * VALUES] for i in at), np.uint8).reshape(len(at), VALUES)
        vx, vy = values(x), values(y)
        for i in range(len(x)):
            size, own = n[x[i]], n[y]
            near = np.flatnonzero((comp[y] != comp[x[i]]) & (100 * np.minimum(own, size) >= 75 * np.maximum(own, size)) & ((y > x[i]) if not two else True) & (doc[y] != doc[x[i]]))
            if form == 1:
                near = near[(own[near] < SMALL) | (size < SMALL)]
            if len(near):
                for j in near[(vy[near] == vx[i]).sum(axis=1) >= least]:
                    if min(own_keys(x[i]) & own_keys(y[j])) == key:
                        p, q = int(doc[x[i]]), int(doc[y[j]])
                        found.add((min(p, q), max(p, q)))
    return found


def weighed(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Likely pairs a, b of different components within buckets. ``left``: key, rep, n, comp in cut form."""
    wanted = common.cut(left.select(F.col("rep").alias("doc")).distinct())
    texts = rows.join(common.checked_broadcast(wanted, wanted.count(), 24), "doc")

    def build(batches):
        for b in batches:
            sets = shingle_sets([t.encode() for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary())], names=["rep", "n", "sketch"])

    sketches = texts.select("doc", "text").mapInArrow(build, "rep long, n long, sketch binary").where("n > 0")
    blocks = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = left.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    against = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi"))))
    placed = placed.withColumn("meet", against).select("key", "meet.lo", "meet.hi", (F.col("own") > F.col("meet.lo")).cast("int").alias("side"), "rep", "n", "comp")
    keys = left.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    dealt = placed.join(sketches.join(keys, "rep"), ["rep", "n"]).select("key", "lo", "hi", "side", "rep", "n", "comp", "sketch", "keys").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "rep")

    def compare(batches):
        at, group = None, []
        pairs = lambda found: pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])
        for b in batches:
            found = []
            for key, lo, hi, *row in zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi", "side", "rep", "n", "comp", "sketch", "keys")), strict=True):
                if (key, lo, hi) != at:
                    found += likely_pairs(at[0], group) if len(group) > 1 else ()
                    at, group = (key, lo, hi), []
                group.append(tuple(row))
            yield pairs(found)
        yield pairs(likely_pairs(at[0], group) if len(group) > 1 else [])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def confirmed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b (distinct, in cut form) whose full sets meet the contract's similarity. ``rows``: doc, text."""
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("slots"))
    members = pairs.join(slots, "a").select(F.col("b").alias("doc"), F.struct(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), F.lit(1).alias("side")).alias("role"))
    centres = slots.select(F.col("a").alias("doc"), F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda i: F.struct(F.col("a").alias("key"), i.alias("slot"), F.lit(0).alias("side")))).alias("role"))
    roles = common.cut(members.unionByName(centres).groupBy("doc").agg(F.collect_list("role").alias("roles")))
    total = roles.agg(F.sum(F.size("roles") * 32 + 40)).head()[0] or 0
    given = rows.join(common.checked_broadcast(roles, 1, total), "doc")

    def build(batches):
        for b in batches:
            docs, keys, slot, side, sets = [], [], [], [], []
            texts = [t.encode() for t in b.column("text").to_pylist()]
            for doc, roles_, s in zip(b.column("doc").to_pylist(), b.column("roles").to_pylist(), shingle_sets(texts), strict=True):
                raw = s.tobytes()
                for r in roles_:
                    docs.append(doc)
                    keys.append(r["key"])
                    slot.append(r["slot"])
                    side.append(r["side"])
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(slot, pa.int32()), pa.array(side, pa.int32()), pa.array(sets, pa.binary())], names=["doc", "key", "slot", "side", "shingles"])

    dealt = given.select("doc", "text", "roles").mapInArrow(build, "doc long, key long, slot int, side int, shingles binary").repartition("key", "slot").sortWithinPartitions("key", "slot", "side")

    def compare(batches):
        at, centre = None, []
        for b in batches:
            left, right = [], []
            for doc, key, slot, side, raw in zip(*(b.column(c).to_pylist() for c in ("doc", "key", "slot", "side", "shingles")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (key, slot) != at:
                    at, centre = (key, slot), []
                if side == 0:
                    centre.append(s)
                    continue
                for c in centre:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if 100 * both >= 75 * (len(c) + len(s) - both) and both:
                        left.append(key)
                        right.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of the nodes of edges a, b, by large-star and small-star steps."""
    now = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = common.cut(small)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def alike(x: str, y: str):
    """Sizes that allow the similarity."""
    return (100 * F.least(x, y)) >= (75 * F.greatest(x, y))


def several(rows: DataFrame, comps: DataFrame, count: int) -> DataFrame:
    """Rows (key, rep, n) of buckets that hold several components, with comp."""
    labels = common.checked_broadcast(comps.select(F.col("node").alias("rep"), "comp"), count, 40)
    rows = rows.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(mixed, "key").select("key", "rep", "n", "comp")


def links(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """node, comp over representatives. ``rows``: doc, text; ``reps``: rep, n, keys, in cut form."""
    buckets = reps.select("rep", "n", F.explode("keys").alias("key"))
    counts = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = common.cut(buckets.join(counts, "key"))
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighted = shared.join(weight, "rep")
    head = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"), "n")).alias("c"))
    star = weighted.join(head, "key").where((F.col("rep") != -F.col("c.r")) & alike("n", "c.n"))
    best = star.groupBy("rep").agg(F.max("c").alias("c")).select((-F.col("c.r")).alias("a"), F.col("rep").alias("b"))
    good = common.cut(confirmed(rows, common.cut(best)))
    comps = common.cut(components(good))
    left = common.cut(several(shared.select("key", "rep", "n"), comps, comps.count()))
    more = common.cut(weighed(rows, left))
    if more.isEmpty():
        return comps
    return common.cut(components(good.unionByName(confirmed(rows, more))))


def classed(signed: DataFrame) -> DataFrame:
    """``signed`` with rep, the smallest doc of the rows with its digest, null for rows alone with theirs.

    Only digests of several rows are joined. They are broadcast if counted small; otherwise they are repeated for each of SALTS parts of the
    rows, so that neither a large class nor the empty sets, which have no digest, meet in one task.
    """
    classes = signed.where("digest IS NOT NULL AND doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c"))
    classes = common.cut(classes.where("c > 1").select("digest", "rep"))
    n = classes.count()
    if n * 64 <= common.BROADCAST_BYTES:
        return signed.join(F.broadcast(classes), "digest", "left")
    salted = signed.where("digest IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    spread = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = signed.where("digest IS NULL").withColumn("rep", F.lit(None).cast("long"))
    return salted.join(spread, ["digest", "salt"], "left").drop("salt").unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest identifier reachable by links), kept."""
    common.small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), common.body(F.col(text_col)).alias("text"))
    signed = common.cut(signatures(rows))
    placed = classed(signed)
    members = placed.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep"))
    reps = common.cut(placed.where("doc = coalesce(rep, doc) AND digest IS NOT NULL").select(F.col("doc").alias("rep"), "n", "keys").dropDuplicates(["rep", "n", "keys"]))
    comps = links(rows.where("doc IS NOT NULL"), reps)
    labels = common.checked_broadcast(comps.select(F.col("node").alias("rep"), "comp"), comps.count(), 40)
    found = members.join(labels, "rep", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
