"""Text expressions shared by the operators: tokens, shingles, function words, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import written

SHINGLE = 5
#: Function words by language; fixed values.
FUNCTION_WORDS = {
    "de": ["als", "am", "an", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["a", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y"],
    "fr": ["à", "au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
#: Chinese function words; fixed values.
CHINESE_FUNCTION_WORDS = ["的", "了", "着", "过", "吗", "呢", "吧", "啊", "嘛", "和", "与", "而", "之", "其", "把", "被", "就", "都", "也", "还"]
#: HTML elements that are no content, and entities in the order of decoding; fixed values.
DROPPED = ["script", "style", "head", "nav", "footer"]
ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: A side is broadcast only when its values are counted below this many bytes.
BROADCAST_BYTES = 24 << 20


def tokens(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n words joined by a blank; none for fewer words."""

    def of(w):
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # bound once, or the words would be made anew for each shingle
    return F.get(F.transform(F.array(words), of), 0)


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the distinct runs of n words, made from the words' hashes without joining text."""

    def of(w):
        every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), of), 0)


def is_function_word(word: Column, lang: Column) -> Column:
    return F.coalesce(*[F.when(lang == k, word.isin(v)) for k, v in FUNCTION_WORDS.items()], F.lit(False))


def content_words(text: Column, lang: Column) -> Column:
    """Tokens without function words of the languages that have blanks between words."""
    return F.filter(tokens(text), lambda w: ~is_function_word(w, lang))


def _bytes(field) -> Column:
    kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    return F.octet_length(F.to_json(F.struct(c))) + 16 if kind.startswith(("array", "struct", "map")) else F.lit(16)


def weighed(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once, and the bytes of its values."""
    kept = written(df)
    return kept, kept.agg(F.sum(sum((_bytes(f) for f in kept.schema.fields), F.lit(0)))).head()[0] or 0


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` written once, and whether its values are few enough bytes for a broadcast."""
    kept, size = weighed(df)
    return kept, size <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """``df`` written once, with a broadcast hint if its values are few bytes; without one otherwise, for a shuffle join."""
    kept, few = measured(df)
    return F.broadcast(kept) if few else kept


def row_keys(*columns: str) -> list[Column]:
    """k1, k2: 128 bits of hash of a row's values; rows that repeat have the same."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *columns).alias("k2")]


def epoch_micros(at: str) -> Column:
    """Microseconds since 1970 of a column's times as its zone, or the lack of one, shows them."""
    clock = F.expr(f"hour({at}) * 3600 + minute({at}) * 60").cast("long") * 1_000_000 + (F.expr(f"extract(SECOND FROM {at})") * 1_000_000).cast("long")
    return F.unix_date(F.col(at).cast("date")).cast("long") * 86_400_000_000 + clock


def html_text(html: Column) -> Column:
    """Markdown of an HTML page: content elements as lines, the rest dropped. Scripts go first, as they may hold tags."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?s)<{tag}\b.*?</{tag}>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"(?s)<div class=\"(?:ad|comments?|comment-section)\">.*?</div>", "")
    html = F.regexp_replace(html, r"(?s)<h1>(.*?)</h1>", "\n# $1\n")
    html = F.regexp_replace(html, r"<li[^>]*>", "\n- ")
    html = F.regexp_replace(html, r"<br[^>]*>|<p[^>]*>|</p>", "\n")
    html = F.regexp_replace(html, r"<b>", "")
    html = F.regexp_replace(html, r"<[^>]*>", "")
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(html, r"\n[ \n]*", "\n"), r"^\n|\n$", "")
