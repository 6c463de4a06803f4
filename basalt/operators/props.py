"""Semi-structured columns: JSON text read as variants, its keys found by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are opened; what lies deeper is counted as a container, unopened.
DEPTH = 6


def _kind(name: Column) -> Column:
    """object, array, string, number, boolean or null, of a variant's schema."""
    other = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
    return other.otherwise("number")


def values(rows: DataFrame, id_col: str = "click_id", text: str = "props", depth: int = DEPTH) -> DataFrame:
    """id, path, kind, number, string of each value in the JSON of ``text``, containers too. A path is ``$``, then ``.key`` and ``[]`` for an element of an array.

    One pass without a shuffle or a lambda; each level is spread from the one above it. A container waits in ``found`` and goes on with the first of what it holds.
    """
    v, tables = F.col("v"), rows.sparkSession.tvf
    at = lambda path, value: F.array(F.struct(path.alias("path"), value.alias("v")))
    level = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL").withColumn("found", at(F.col("path"), v))
    for _ in range(depth):
        level = level.lateralJoin(tables.variant_explode_outer(v.outer()).select("pos", "key", F.col("value").alias("inner")))
        level = level.select("id", "found", "pos", "inner", F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.lit("[]"))).alias("path"))
        one = at(F.col("path"), F.col("inner"))
        level = level.select("id", "path", F.col("inner").alias("v"), F.when(F.col("pos").isNull(), F.col("found")).when(F.col("pos") == 0, F.concat("found", one)).otherwise(one).alias("found"))
    flat = level.select("id", F.explode("found").alias("x")).select("id", "x.path", "x.v")
    # an explosion holds the kind, as each use in a projection on another would make it anew
    typed = flat.select("id", "path", "v", F.explode(F.array(F.schema_of_variant("v"))).alias("name")).select("id", "path", "v", _kind(F.col("name")).alias("kind"))
    return typed.select("id", "path", "kind", F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("number"), F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).alias("string"))


def prop_keys(rows: DataFrame, id_col: str = "click_id", text: str = "props") -> DataFrame:
    """path, kind, n, n_different, low, high: what stands at each path of the JSON of ``text``, by kind. Fidelity: stand-in.

    n_different counts different strings or numbers; low and high are of numbers, null otherwise. Text that is no JSON is counted apart, at a null path, as ``bad``; null text as
    ``missing``. Values below DEPTH levels are in their container. Rows that repeat count each.
    """
    found = values(rows, id_col, text)
    once = F.coalesce(F.col("number").cast("string"), "string")
    keys = found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(once).alias("n_different"), F.min("number").alias("low"), F.max("number").alias("high"))
    state = F.when(F.col(text).isNull(), "missing").when(F.try_parse_json(text).isNull(), "bad")
    rest = rows.select(state.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    none = lambda t: F.lit(None).cast(t)
    return keys.unionByName(rest.select(none("string").alias("path"), "kind", "n", F.lit(0).cast("long").alias("n_different"), none("double").alias("low"), none("double").alias("high")))


def item_demand(rows: DataFrame, id_col: str = "click_id", text: str = "props") -> DataFrame:
    """sku, n_clicks, quantity: in how many rows an item stands among the JSON's ``items``, and its quantities together. Fidelity: stand-in.

    Typed by schema on read: an item without a whole number as sku is left out, a quantity that is none counts 0; text that is no JSON holds none.
    """
    items = F.try_variant_get(F.try_parse_json(text), "$.items", "array<variant>")
    spread = rows.select(F.monotonically_increasing_id().alias("row"), items.alias("items")).select("row", F.explode("items").alias("item"))
    at = lambda key: F.try_variant_get("item", f"$.{key}", "variant")
    whole = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    typed = spread.select("row", whole(at("sku")).alias("sku"), F.coalesce(whole(at("qty")), F.lit(0)).alias("qty")).where("sku IS NOT NULL")
    by_row = typed.groupBy("row", "sku").agg(F.sum("qty").alias("qty"))
    return by_row.groupBy("sku").agg(F.count(F.lit(1)).alias("n_clicks"), F.sum("qty").alias("quantity"))
