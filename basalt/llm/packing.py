"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

Texts are tokenised in their own tasks and cut every ``seq_len`` ids. Whole pieces are sequences by themselves;
what remains of each document is an item to pack. Pieces are dealt by a hash of the row and its copy, so that each task
packs a random part of the corpus, and taken in the order of that hash in groups of at most ``group_docs``
items. In a group the items go, longest first, to the first sequence with room: the leaves of a tournament
tree hold the free room of each sequence and its inner nodes the largest below, so that the first fit is found
in one descent. A task holds one group's ids at a time, whatever the size of the corpus.

The emptiest sequences of a group are then dissolved into the gaps of the others, as documents may be cut.

Defined cases: null and empty text is one piece with the end id alone; repeated rows are packed as separate
documents, told apart by ``copy``, a number of each row made from its hash, its input partition and its count among equal rows there, so
that copies are dealt apart too; an empty table gives an empty result; only the identifier is carried along, so other columns cannot
clash. Order within a task follows the hash, start and identifier, so a retried task repeats its result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

SEQ_LEN = 2048
GROUP_DOCS = 4096
END_ID = 1
#: Code points beyond which the other library, which takes texts of any length, makes the same ids.
LONG_TEXT = 1_000_000
NTH = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_files() -> tuple[str, str]:
    """The public byte-level vocabulary, in both libraries' forms."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(json_path: str, ranks_path: str | None):
    """A function from text to ids. The ranks form of the vocabulary gives the same ids faster; very long texts,
    texts it can't take and texts that hold an added token, which is one id, go through the other library."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        if len(text) <= LONG_TEXT and not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except ValueError:
                pass
        return slow.encode(text, add_special_tokens=False).ids

    return encode


class Tournament:
    """Free room of up to ``n`` sequences; ``place`` finds the first with enough room."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        best[at] -= size
        leaf, at = at - self.leaves, at // 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        return leaf


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Item numbers of each sequence."""
    if not sizes:
        return []
    tree, bins = Tournament(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.place(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Dissolve the emptiest sequences of (item, from, length) pieces into the gaps of the fuller ones."""
    fill = lambda b: sum(p[2] for p in b)
    bins = sorted(bins, key=fill, reverse=True)
    gaps = [room - fill(b) for b in bins]
    at = 0
    while len(bins) > 1:
        need = room - gaps[-1]
        if sum(gaps[at:-1]) < need:
            break
        for item, begin, length in bins.pop():
            while length:
                while not gaps[at]:
                    at += 1
                put = min(length, gaps[at])
                bins[at].append((item, begin, put))
                begin, length, gaps[at] = begin + put, length - put, gaps[at] - put
        gaps.pop()
    return bins


def pack_documents(docs: DataFrame, seq_len: int = SEQ_LEN, group_docs: int = GROUP_DOCS, end_id: int = END_ID, files: tuple[str, str | None] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, copy, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits) of each piece."""
    common.small_batches(docs.sparkSession, 500)
    files = files or tokenizer_files()
    rows = docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text"))
    rows = rows.withColumn("deal", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {kind}, start long, length long, doc_tokens long"

    def cut(batches):
        encode, seen = encoder(*files), {}
        place = mix(np.array([TaskContext.get().partitionId()], dtype=np.uint64))
        for b in batches:
            out, nth = [[] for _ in range(6)], []
            for h in b.column("deal").to_pylist():
                nth.append(seen.get(h, 0))
                seen[h] = nth[-1] + 1
            deals = mix(mix(b.column("deal").to_numpy().view(np.uint64) + np.array(nth, dtype=np.uint64) * NTH) + place).view(np.int64).tolist()
            for i, (text, deal) in enumerate(zip(b.column("text").to_pylist(), deals, strict=True)):
                ids = encode(text)
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                for s in range(0, len(ids), seq_len):
                    for o, v in zip(out, (i, s, min(seq_len, len(ids) - s), len(ids), deal, raw[4 * s : 4 * (s + seq_len)]), strict=True):
                        o.append(v)
            which, start, length, total, deal, raw = out
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, deal)), pa.array(raw, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "deal", "ids"])

    pieces = rows.mapInArrow(cut, f"{head}, deal long, ids binary")
    dealt = pieces.repartition("deal").sortWithinPartitions("deal", "start", "doc_id")

    def pack(batches):
        task, n, items = TaskContext.get().partitionId() << 40, 0, []
        names = ["doc_id", "copy", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        ints = pa.int64()

        def batch(found, id_type):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, ints) for c in cols[1:7]), pa.array(cols[7], pa.binary())], names=names)

        def group():
            nonlocal n
            bins = [[(i, 0, items[i][3]) for i in b] for b in first_fit_decreasing([x[3] for x in items], seq_len)]
            found = []
            for b in fill_gaps(bins, seq_len):
                at = 0
                for i, begin, length in b:
                    doc, copy, start, _, total, raw = items[i]
                    found.append((doc, copy, start + begin, length, total, task | n, at, raw[4 * begin : 4 * (begin + length)]))
                    at += length
                n += 1
            items.clear()
            return found

        id_type = None
        for b in batches:
            id_type, found = b.schema.field("doc_id").type, []
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "deal", "start", "length", "doc_tokens", "ids")), strict=True):
                if row[3] == seq_len:
                    found.append((*row[:5], task | n, 0, row[5]))
                    n += 1
                else:
                    items.append(row)
                    if len(items) == group_docs:
                        found += group()
            if found:
                yield batch(found, id_type)
        if items:
            yield batch(group(), id_type)

    return dealt.mapInArrow(pack, f"{head.replace('start long', 'copy long, start long')}, sequence_id long, offset long, ids binary")
