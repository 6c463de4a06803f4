"""Personal data: generators propose spans, boosted trees and calibrated thresholds select them.

High-recall generators propose spans, which may overlap, with built-in regular expressions. Four base kinds
(email, ip, card, phone) have a fixed definition and always stay. Further kinds (local phone numbers, identity
numbers, account numbers, spelled-out addresses, short card numbers) are kept only when boosted trees over format
and context features give them a calibrated probability above the threshold of their kind.

All of it is built-in column expressions in one pass without a shuffle: spans come from the pieces between the
matches, whose lengths add up to the offsets. The expressions are written so that no text makes them backtrack:
runs are possessive and start only where a run starts (or where the match before ended, ``\\G``), which finds the
same leftmost matches as the plain pattern.

The trees are fitted on ``SAMPLE`` labelled sentences (the documented bound) written by the rules of ``labelled``:
values of each kind, right and wrong ones, in sentences of four languages that speak for, against or neither, so that
no single feature tells them apart. A quarter is held out to calibrate the score of each kind and to choose its threshold: the
lowest at which ``PRECISION`` is met, or the one of highest precision where none meets it. Proposals that touch a base span are left out before scoring.

Defined cases: null and empty text has no spans; repeated rows give repeated results; an empty table gives an
empty result; other columns pass through, and added columns replace columns of the same names.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 6000
CONTEXT = 32
PRECISION = 0.95
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,20}",
    "short_card": r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]){9,11}(?![0-9-])",
}
KINDS = [*BASE, *FURTHER]
#: Beginnings of words near a span that speak for or against personal data; fixed values.
CLUES = {
    "contact": r"(?i)\b(?:phone|tel|call|ring|mobile|cell|fax|contact|reach|mail|write|anruf|ruf|handy|kontakt|erreich|schreib|appel|portable|joind|joign|écri|ecri|llam|móvil|movil|escri|whatsapp|sms|number is|nummer ist|numéro|número)",
    "money": r"(?i)\b(?:card|visa|amex|pay|paid|credit|debit|account|iban|bank|konto|karte|zahl|überweis|carte|compte|banque|virement|tarjeta|cuenta|banco|pag|transfer|wire|geld|argent|dinero)",
    "person": r"(?i)\b(?:ssn|social|security|insur|passport|identi|sozial|versicher|ausweis|sécurité|securite|assur|seguridad|seguro|born|taxpayer|my|mine|mein|mon|ma|mi)\b",
    "against": r"(?i)(?:\b(?:version|order|invoice|isbn|part|build|ref|code|page|issue|ticket|serial|rev|batch|tracking|model|item|bestell|rechnung|artikel|seite|teil|commande|facture|pièce|pedido|factura|pieza|página|line|error|score|result|chapter|section|art|lot|sku)|[#$€£=])",
}
#: Lengths of account numbers (ISO 13616) by country; fixed values.
ACCOUNT_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
SPANS = "array<struct<kind:string,s:int,e:int,hit:string,left:string,right:string>>"
FEATURES = ["kind", "digits", "length", "seps", "luhn", "mod97", "distinct", *CLUES, "joined", "shape", "digits_near"]


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of struct(kind, s, e, hit, left, right); offsets in code points."""
    def step(acc, i):
        piece, hit = F.get(acc["p"], i), F.get(acc["m"], i)
        start = acc["at"] + F.char_length(piece)
        end = start + F.char_length(hit)
        one = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), hit.alias("hit"), F.right(piece, F.lit(CONTEXT)).alias("left"), F.left(F.get(acc["p"], i + 1), F.lit(CONTEXT)).alias("right"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"), acc["m"].alias("m"), acc["p"].alias("p"))

    def walk(found):
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"), found.alias("m"), F.split(text, pattern, -1).alias("p"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))

    # the matches are bound in an array of their own, so that the text is searched once, and cut only where it has some
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), walk), 0)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0)


def mod97(hit: Column) -> Column:
    """Whether the ISO 13616 check digits hold."""
    bare = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(F.char_length(c) == 0, a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return hit.rlike("^[A-Z]{2}[0-9]{2}") & (rest == 1)


def holds(span: Column) -> Column:
    """Whether a span of a base kind meets its definition."""
    kind, hit = span["kind"], span["hit"]
    number = digits(hit)
    n = F.char_length(number)
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    ip = F.forall(F.split(hit, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255))
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", n.between(16, 19) & luhn(number)).otherwise(n.between(8, 15))


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one base kind. Only texts that hold the sign of the kind are searched."""
    found = spans(text, kind, BASE[kind])
    if kind == "email":
        found = F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast(SPANS))
    return F.filter(found, holds)


def shape(span: Column) -> Column:
    """Whether a further kind's span looks as numbers of its kind are given out."""
    hit = span["hit"]
    bare = F.regexp_replace(hit, " ", "")
    length = F.coalesce(*[F.when(bare.startswith(c), F.char_length(bare) == n) for c, n in ACCOUNT_LENGTH.items()], F.lit(False))
    of = {
        "local_phone": hit.rlike(r"^\(?[02-9][0-9]*\)?[\x20.-][2-9]"),
        "identity": hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
        "account": length,
        "spelled_email": hit.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at)$"),
        "short_card": hit.rlike(r"^(?:3[04-9]|4|5[1-5]|6)"),
    }
    return F.coalesce(*[F.when(span["kind"] == k, c) for k, c in of.items()], F.lit(False))


def features(span: Column) -> list[Column]:
    hit, near = span["hit"], F.concat(span["left"], F.lit(" "), span["right"])
    number = digits(hit)
    flag = lambda c: c.cast("double")
    code = F.coalesce(*[F.when(span["kind"] == k, F.lit(float(i))) for i, k in enumerate(KINDS)])
    return [
        code, flag(F.char_length(number)), flag(F.char_length(hit)), flag(F.char_length(F.regexp_replace(hit, "[A-Za-z0-9]", ""))),
        flag(luhn(number)), flag(mod97(hit)), flag(F.size(F.array_distinct(F.split(number, "")))),
        *[flag(near.rlike(p)) for p in CLUES.values()],
        flag(span["left"].rlike("[A-Za-z0-9_/=-]$") | span["right"].rlike("^[A-Za-z0-9_/=-]")),
        flag(shape(span)), flag(F.char_length(digits(near))),
    ]


# --- fitting -----------------------------------------------------------------------------------

#: Sentences for values that are personal, of several languages; {} is the value.
FOR = {
    "local_phone": ["You can get hold of me under {} after six.", "call {} and ask for Ann", "My number is {}.", "Ruf mich bitte unter {} an", "erreichbar: {}", "mon portable : {}", "Appelez le {} ce soir", "mi móvil es el {}", "llámame al {} mañana", "Tel. {}", "{} is where she picks up", "ph {} (evenings)", "Home: {}", "reach the clinic at {}", "text me - {}"],
    "identity": ["SSN {}", "her social security number, {}, was on the form", "applicant {} was born in May", "Sozialversicherung {}", "numéro d'assuré {}", "seguridad social {}", "taxpayer id {}", "patient {} came in on Monday", "my social: {}", "insured under {}"],
    "account": ["IBAN {}", "please wire it to {} by Friday", "Kontonummer {}", "Bitte überweisen Sie an {}", "virement sur le compte {}", "mi cuenta es {}", "send the rent to {} thanks", "{} belongs to my sister", "refund to: {}", "Bankverbindung: {}"],
    "spelled_email": ["write to {}", "you can reach Jane: {}", "schreib an {}", "écrivez à {}", "escribe a {} por favor", "contact - {}", "{} answers quickly", "bugs go to {} please", "author: {}", "(by {})"],
    "short_card": ["amex {} ok", "charge it to {}", "paid with {} last night", "meine Karte {}", "carte bancaire {}", "tarjeta {}", "card no. {} expires soon", "debit {}", "the number on the front is {}", "he read out {} over the phone"],
}
#: Sentences in which values of these forms are no personal data.
AGAINST = ["invoice {} sent", "order no {} shipped", "build {} failed", "see page {}", "part {} of the manual", "Rechnung {} liegt bei", "Artikel {} ist ausverkauft", "commande {} expédiée", "facture n° {}", "el pedido {} ya salió", "tracking {}", "version {} is out", "isbn {}", "ticket #{} closed", "serial {} on the back", "score {} after extra time", "error {} at line 7", "SKU {}", "$ {} in total", "result = {}", "lot {} was recalled", "model {} fits", "ref: {}"]
NEUTRAL = ["and then {} again", "the figure {} stood there", "{}", "dort stand {} geschrieben", "puis {} encore", "y luego {} otra vez", "({})", "between them {} was found", "of {} or so", "- {} -"]
FILLER = ["The meeting was long.", "It rained all day.", "Das Wetter war gut.", "Il fait beau.", "Hace sol.", "We walked home.", "Nobody came.", "12 people, 3 dogs.", "In 2019 it closed.", ""]


def check_digits(bban: str, country: str) -> str:
    turned = "".join(str(int(c, 36)) for c in f"{bban}{country}00")
    return f"{98 - int(turned) % 97:02d}"


def luhn_digit(number: str) -> str:
    return next(str(c) for c in range(10) if sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(f"{number}{c}")))) % 10 == 0)


def value_of(kind: str, good: bool, rng: random.Random) -> str:
    """A value in the form that a generator proposes. A wrong one fails what can be checked, if anything can."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "local_phone":
        area, exchange = (f"{rng.choice('23456789')}{number(2)}", f"{rng.choice('23456789')}{number(2)}")
        if not good:
            area, exchange = rng.choice([(f"1{number(2)}", exchange), (area, f"{rng.choice('01')}{number(2)}")])
        if good and rng.random() < 0.3:
            area = f"0{number(3)}"
        sep = rng.choice(" -.")
        return f"({area}) {exchange}{rng.choice('-. ')}{number(4)}" if rng.random() < 0.3 else sep.join([area, exchange, number(4)])
    if kind == "identity":
        return f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if good else rng.choice([f"{rng.choice(['000', '666', f'9{number(2)}'])}-{number(2)}-{number(4)}", f"{number(3)}-00-{number(4)}", f"{number(3)}-{number(2)}-0000"])
    if kind == "account":
        country = rng.choice(list(ACCOUNT_LENGTH)[:-1])
        bban = number(ACCOUNT_LENGTH[country] - 4)
        if country in ("GB", "NL", "IE"):
            bban = f"{''.join(rng.choices('ABCDEFGHKLMNPRST', k=4))}{bban[4:]}"
        if good:
            text = f"{country}{check_digits(bban, country)}{bban}"
        else:
            text = f"{rng.choice([country, 'XK', 'PN', 'SN', 'AB'])}{number(2)}{bban}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.4 else text
    if kind == "spelled_email":
        who = rng.choice(["ana", "lee.k", "j_doe", "m42", "info", "jane", "rob+x", "sales", "tim-o"])
        if not good:
            return f"{rng.choice(['meet', 'look', 'arrive', 'x1', '9', who])}{rng.choice([' (at) ', '[at]', ' [at] '])}{rng.choice(['noon', 'gate', 'the', 'station', 'line'])}.{rng.choice(['then', 'py', 'we', 'exe', 'next', 'txt', 'com'])}"
        return f"{who}{rng.choice([' (at) ', '(at)', '[at]', ' [at] '])}{rng.choice(['mail8', 'example', 'post-box', 'uni', 'firma'])}{rng.choice(['.', ' (dot) ', '[dot]'])}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'dev'])}"
    body = f"{rng.choice(['37', '34', '30', '36', '38', '4'])}{number(11)}" if good or rng.random() < 0.5 else number(13)
    body = body[: rng.choice([12, 13, 14])]
    whole = f"{body}{luhn_digit(body)}" if good else f"{body}{rng.choice([c for c in '0123456789' if c != luhn_digit(body)])}"
    return f"{whole[:4]} {whole[4:10]} {whole[10:]}" if rng.random() < 0.3 else whole


def labelled(rows: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, int, int, bool]]:
    """Sentences with one planted value each: text, kind, start and end of the value, whether it is personal data.

    It is if the value is right and the sentence doesn't speak against it; a right value in a sentence that says neither
    counts if its kind has check digits, or by the toss of a coin weighted three to one where its form is rare by chance.
    """
    rng, out = random.Random(seed), []
    for i in range(rows):
        kind = list(FURTHER)[i % len(FURTHER)]
        good = rng.random() < 0.6
        way = rng.choices(["for", "neutral", "against"], [5, 2, 3])[0]
        if kind in ("account", "short_card"):
            truth = good and (way != "against" or (kind == "account" and rng.random() < 0.5))
        elif kind == "spelled_email":
            truth = good
        else:
            truth = good and (way == "for" or (way == "neutral" and kind == "identity" and rng.random() < 0.75))
        frame = rng.choice({"for": FOR[kind], "neutral": NEUTRAL, "against": AGAINST}[way])
        left, _, right = frame.partition("{}")
        left = f"{rng.choice(FILLER)} {left}" if rng.random() < 0.7 else left
        value = value_of(kind, good, rng)
        out.append((f"{left}{value}{right} {rng.choice(FILLER)}", kind, len(left), len(left) + len(value), truth))
    return out


class Forest:
    """Boosted trees on logistic loss, fitted on the driver on a bounded sample, with a calibration and a threshold a kind."""

    def __init__(self, trees, calibration: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.calibration, self.thresholds = trees, calibration, thresholds

    @staticmethod
    def _split(x, g, h):
        best = (1e-3, None, None)
        total = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            values, where = np.unique(x[:, j], return_inverse=True)
            left_g, left_h = np.cumsum(np.bincount(where, g))[:-1], np.cumsum(np.bincount(where, h))[:-1]
            if len(left_g):
                gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - total
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, float(values[k]))
        return best[1:]

    @classmethod
    def _grow(cls, x, g, h, depth, rate):
        j, cutoff = cls._split(x, g, h) if depth and len(x) > 20 else (None, None)
        if j is None:
            return float(rate * g.sum() / (h.sum() + 1.0))
        left = x[:, j] <= cutoff
        return (j, cutoff, cls._grow(x[left], g[left], h[left], depth - 1, rate), cls._grow(x[~left], g[~left], h[~left], depth - 1, rate))

    @classmethod
    def value(cls, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], cls.value(tree[2], x), cls.value(tree[3], x))

    @classmethod
    def fit(cls, x, y, rounds=48, rate=0.2, depth=4, precision=PRECISION):
        held = np.arange(len(y)) // len(FURTHER) % 4 == 3
        f, trees = np.zeros(len(y)), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            trees.append(cls._grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], depth, rate))
            f += cls.value(trees[-1], x)
        calibration, thresholds = {}, {}
        for k, kind in enumerate(KINDS):
            own = held & (x[:, 0] == k)
            if not own.any():
                continue
            a, b = 1.0, 0.0  # sigmoid(a * f + b)
            for _ in range(400):
                e = 1 / (1 + np.exp(-(a * f[own] + b))) - y[own]
                a, b = a - 0.05 * float((e * f[own]).mean()), b - 0.05 * float(e.mean())
            calibration[kind] = (a, b)
            prob = 1 / (1 + np.exp(-(a * f[own] + b)))
            reached = [(float(t), float(y[own][prob >= t].mean())) for t in np.round(np.arange(0.3, 1.0, 0.02), 2) if (prob >= t).any()]
            thresholds[kind] = next((t for t, hit in reached if hit >= precision), max(reached, key=lambda x: x[1])[0])
        return cls(trees, calibration, thresholds)

    def score(self, x) -> np.ndarray:
        """Calibrated probabilities of rows of features, without Spark."""
        f = sum(self.value(t, x) for t in self.trees)
        a, b = (np.array([self.calibration.get(k, (1.0, 0.0))[i] for k in KINDS])[x[:, 0].astype(int)] for i in (0, 1))
        return 1 / (1 + np.exp(-(a * f + b)))

    def sql(self, f: str) -> str:
        """The calibrated probability as an SQL expression over an array of features."""

        def of(tree):
            return f"CASE WHEN {f}[{tree[0]}] <= {tree[1]!r}D THEN {of(tree[2])} ELSE {of(tree[3])} END" if isinstance(tree, tuple) else f"{tree!r}D"

        of_kind = lambda i: f"CASE {f}[0] " + " ".join(f"WHEN {float(k)!r}D THEN {self.calibration.get(n, (1.0, 0.0))[i]!r}D" for k, n in enumerate(KINDS)) + " END"
        return f"1 / (1 + exp(-({of_kind(0)} * ({' + '.join(map(of, self.trees))}) + {of_kind(1)})))"


def proposals(text: Column) -> Column:
    found = {k: spans(text, k, p) for k, p in FURTHER.items()}
    # only texts that hold the sign of the kind are searched
    none = F.array().cast(SPANS)
    found["spelled_email"] = F.when(F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), found["spelled_email"]).otherwise(none)
    return F.concat(*found.values())


def measured(spark: SparkSession, rows: list[tuple[str, str, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and sentence of all proposals in labelled sentences; only one that meets the planted value can be true."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, kind string, s int, e int, truth boolean")
    span = F.col("span")
    meets = (span["kind"] == F.col("kind")) & (span["s"] < F.col("e")) & (F.col("s") < span["e"])
    spread = df.withColumn("span", F.explode(proposals(F.col("text"))))
    got = spread.select("id", (F.col("truth") & meets).alias("truth"), F.array(*features(span)).alias("x")).collect()  # a few a sentence
    got.sort(key=lambda r: (r["id"], r["x"]))
    return np.array([r["x"] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([r["truth"] for r in got], dtype=float), np.array([r["id"] for r in got])


@cache
def _fitted(rows: int, _app: str) -> Forest:
    x, y, _ = measured(SparkSession.active(), labelled(rows))
    return Forest.fit(x, y)


def fitted(spark: SparkSession, rows: int = SAMPLE) -> Forest:
    """The model, fitted once a process."""
    return _fitted(rows, spark.sparkContext.applicationId)


# --- the operator ------------------------------------------------------------------------------


def find_pii(docs: DataFrame, model: Forest | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and pii (base and selected spans): arrays of kind, s, e, hit, score."""
    model = model or fitted(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("base_spans", "pii")]
    text = F.col("__text")
    rows = common.with_columns_of(docs, own).withColumn("__text", common.body(F.col(text_col)))
    rows = rows.select("*", *[base_spans(text, k).alias(f"__{k}") for k in BASE], proposals(text).alias("__more"))
    given = lambda s, score: F.struct(s["kind"].alias("kind"), s["s"].alias("s"), s["e"].alias("e"), s["hit"].alias("hit"), score.alias("score"))
    sure = F.transform(F.concat(*[F.col(f"__{k}") for k in BASE]), lambda s: given(s, F.lit(1.0)))
    over = lambda s: F.coalesce(*[F.when(s["kind"] == k, s["score"] >= t) for k, t in model.thresholds.items()], F.lit(False))
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    rows = rows.withColumn("base_spans", sure)
    rows = rows.withColumn("__more", F.filter("__more", lambda s: ~F.exists("base_spans", lambda b: meets(s, b))))
    # features are bound once an array of their own, which keeps the trees' references short
    rows = rows.withColumn("__x", F.transform("__more", lambda s: F.array(*features(s))))
    rows = rows.withColumn("__p", F.expr(f"transform(__x, f -> {model.sql('f')})"))
    rows = rows.withColumn("__more", F.filter(F.zip_with("__more", "__p", given), over))
    free = F.filter("__more", lambda s: ~F.exists("__more", lambda o: meets(s, o) & ((o["score"] > s["score"]) | ((o["score"] == s["score"]) & (o["kind"] < s["kind"])))))
    return rows.withColumn("pii", F.concat("base_spans", free)).select(*own, "base_spans", "pii")


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: Forest | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span of the text replaced by its kind in brackets."""
    rows = find_pii(docs, model, text_col).withColumn("__text", common.body(F.col(text_col)))
    ordered = F.array_sort("pii", lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        put = F.concat(F.substring(F.col("__text"), acc["at"] + 1, s["s"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["s"] < acc["at"], acc).otherwise(F.struct(s["e"].alias("at"), F.array_append(acc["out"], put).alias("out")))

    text = F.aggregate(ordered, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("__text"), a["at"] + 1, F.char_length("__text"))))
    return rows.withColumn(text_col, text).select(*docs.columns)
