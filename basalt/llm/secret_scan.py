"""Secret scans: keyword prefilter, anchored patterns near hits, embedded checksums.

One Aho-Corasick automaton runs over the text's bytes with A-Z in lower case and reports keywords; a second runs
over the bytes mapped to two classes (hexadecimal digit or not) and reports 24 digits in a row, so hexadecimal
runs, which have no keyword, are prefiltered as well. Only at a hit is the pattern of its kind tried, anchored
there. Hits come in order and a match uses up its text, so the matches are those that a leftmost scan finds.
Kinds with an embedded checksum (``CHECKED``) are added only when the checksum holds.

Texts are scanned whole, one Arrow batch at a time, without a shuffle or state between rows.

Defined cases: null and empty text has no findings; repeated rows give repeated results; an empty table gives
an empty result; only the identifier is carried along, so other columns cannot clash.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["assign", "access", "hex", "github", "npm", "age", "xprv"]
BASE = KINDS[:3]
CHECKED = KINDS[3:]
#: Patterns of the contract and of public token formats; fixed values. On bytes, so letters are ASCII.
PATTERNS = {
    "assign": re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"),
    "age": re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![A-Z0-9])"),
    "xprv": re.compile(rb"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
}
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "api_key", "apikey"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "age": ["age-secret-key-1"],
    "xprv": ["xprv", "tprv"],
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HEXES = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
SCHEMA = "array<struct<kind:string,s:long,e:long>>"


@cache
def automata():
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    runs.add_word("h" * LEAST["hex"], LEAST["hex"])
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def _crc62(token: bytes) -> bool:
    """Last six of the characters after the underscore: CRC-32 of those before, in base 62."""
    secret = token.partition(b"_")[2]
    value, out = binascii.crc32(secret[:-6]), ""
    while value:
        value, r = divmod(value, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0").encode() == secret[-6:]


def _bech32(token: bytes) -> bool:
    prefix, _, data = token.decode().lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def _base58check(token: bytes) -> bool:
    n = 0
    for c in token.decode():
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


VALID = {"github": _crc62, "npm": _crc62, "age": _bech32, "xprv": _base58check}


def scan(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end in code points, by start and then by kind as listed in KINDS."""
    raw = text.encode()
    words, runs = automata()
    hits = [(at - n + 1, kind) for at, (kind, n) in words.iter(raw.translate(FOLD).decode("latin-1"))]
    hits += [(at - n + 1, "hex") for at, n in runs.iter(raw.translate(HEXES).decode("latin-1"))]
    if not hits:
        return []
    found, ended = [], dict.fromkeys(KINDS, 0)
    for at, kind in sorted(hits):
        if at < ended[kind] or not (m := PATTERNS[kind].match(raw, at)):
            continue
        ended[kind] = m.end()
        good = VALID[kind](m.group()) if kind in VALID else len(m.group(1) if kind == "assign" else m.group()) >= LEAST[kind]
        if good:
            found.append((kind, at, m.end()))
    if len(raw) != len(text):
        places, chars, last = {}, 0, 0
        for p in sorted({p for _, s, e in found for p in (s, e)}):
            chars, last = chars + len(raw[last:p].decode()), p
            places[p] = chars
        found = [(k, places[s], places[e]) for k, s, e in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings: an array of kind, s, e."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), common.body(F.col(text_col)).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    def work(batches):
        for b in batches:
            found = [[{"kind": k, "s": s, "e": e} for k, s, e in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "findings"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, findings {SCHEMA}")
