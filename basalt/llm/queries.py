"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, fingerprint, lang_id, line_dedup, lm_scoring, mixing, near_dedup, oracles, packing, panes, periodic, pii, quality, secret_scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "copy")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("findings")).alias("spans"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")), counted=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_sizes(mixing.sizes(documents(spark, sf_dir)))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", lang_id.held_out().alias("held_out"))
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.revise_panes(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents is made periodic first, as the contract asks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: F.Column) -> F.Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i)), " ")).otherwise(F.lit(""))

    # the words are bound once, or they would be made anew for each place
    words = F.array(F.regexp_extract_all("text", F.lit(f"({common.WORD_RE})"), F.lit(1)))
    text = F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(words, rewritten), 0)).otherwise(F.col("text"))
    found = periodic.find_runs(documents(spark, sf_dir).select("doc_id", text.alias("text")))
    best = periodic.best_run(F.col("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    machine = quality.fit(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_secret_scan": op2_secret_scan, "op3_fingerprint": op3_fingerprint, "op4_lm_scoring": op4_lm_scoring, "op5_mixing": op5_mixing, "op6_lang_id": op6_lang_id, "op7_pii": op7_pii, "op8_line_dedup": op8_line_dedup, "op9_near_dedup": op9_near_dedup, "op10_exact_dedup": op10_exact_dedup, "op11_window_panes": op11_window_panes, "op12_periodic_runs": op12_periodic_runs, "op13_quality": op13_quality}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": oracles.MIXING, "op8_line_dedup": oracles.LINES, "op9_near_dedup": oracles.NEAR, "op10_exact_dedup": oracles.EXACT, "op11_window_panes": oracles.PANES}
