"""Line-wise JSON logs, read so that bad lines are counted, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, v (the parsed line, null if it is no JSON) and is_object; blank lines are left out."""
    df = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    return df.select("value", v.alias("v"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (its number in the file, from 1, blank lines counted), value, v and is_object; blank lines are left out.

    Numbers come from counts per block of a file and the order inside a block, so no task sees a whole file.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a block
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("file", "_block").orderBy("_i"))).join(blocks.withColumn("_from", offset).drop("_n"), ["file", "_block"])
    v = F.try_parse_json("value")
    out = rows.where(F.trim("value") != "").select("file", (F.col("_from") + F.col("_k")).alias("line"), "value", v.alias("v"))
    return out.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def text_field(name: str, kind: str = "string"):
    return F.try_variant_get(F.col("v"), f"$.{name}", kind)


def is_string(name: str):
    return F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{name}", "variant")) == "STRING"


def id_counts(spark: SparkSession, path: str, key: str = "synthetic_id") -> tuple[DataFrame, DataFrame]:
    """(attempts per id, one row of totals: n_lines, n_malformed, last_call).

    A line is malformed if it is no JSON, no object, or its id is no non-empty string.
    """
    rows = lines(spark, path).withColumn("id", F.when(F.coalesce(F.col("is_object") & is_string(key), F.lit(False)), F.nullif(text_field(key), F.lit(""))))
    counts = rows.where("id IS NOT NULL").groupBy(F.col("id").alias(key)).agg(F.count("*").alias("n"))
    totals = rows.agg(F.count("*").alias("n_lines"), F.count_if(F.col("id").isNull()).alias("n_malformed"), F.max(text_field("agent_call_number", "bigint")).alias("last_call"))
    return counts, totals


def completed(spark: SparkSession, path: str, key: str = "variant_id") -> DataFrame:
    """Distinct ids of lines whose status is ok."""
    return lines(spark, path).where(F.col("is_object") & (text_field("status") == "ok")).select(text_field(key).alias(key)).where(f"{key} IS NOT NULL").distinct()


def resume_counts(spark: SparkSession, path: str, key: str = "variant_id") -> DataFrame:
    """One row: n_records (lines that are objects), n_malformed (others), n_completed (distinct ids of lines whose status is ok)."""
    ok = F.col("is_object") & (text_field("status") == "ok")
    return lines(spark, path).agg(F.count_if("is_object").alias("n_records"), F.count_if(~F.col("is_object")).alias("n_malformed"), F.countDistinct(F.when(ok, text_field(key))).alias("n_completed"))


def strict(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines; one that is no JSON object raises an error with its file and number when it is read."""
    rows = numbered_lines(spark, path)
    bad = F.raise_error(F.concat(F.lit("not a JSON object: line "), F.col("line").cast("string"), F.lit(" of "), F.col("file")))
    return rows.select("line", F.when(F.col("is_object"), F.col("value")).otherwise(bad.cast("string")).alias("value"), "v")


def fold_events(events: DataFrame, by: str, order: str) -> DataFrame:
    """Per call: the last agent message, thread id, last usage and errors of its event lines (``value`` holds JSON)."""
    v = F.try_parse_json("value")
    e = events.withColumn("v", v).withColumn("type", F.try_variant_get("v", "$.type", "string"))
    message = F.when((F.col("type") == "item.completed") & (F.try_variant_get("v", "$.item.type", "string") == "agent_message"), F.try_variant_get("v", "$.item.text", "string"))
    pick = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    thread = F.when(F.col("type") == "thread.started", F.try_variant_get("v", "$.thread_id", "string"))
    usage = F.when(F.col("type") == "turn.completed", F.try_variant_get("v", "$.usage", "map<string,bigint>"))
    error = F.when(F.col("type").isin("error", "turn.failed"), F.coalesce(F.try_variant_get("v", "$.message", "string"), F.try_variant_get("v", "$.error", "string"), F.col("type")))
    out = e.groupBy(by).agg(pick(message).alias("message"), pick(thread).alias("thread_id"), F.max_by(usage, F.when(usage.isNotNull(), F.col(order))).alias("usage"), F.count_if(F.col("v").isNull()).alias("n_malformed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct(F.col(order).alias("o"), error.alias("m"))))), lambda x: x["m"]), "; ").alias("errors"))
    return out.withColumn("usage", F.map_filter("usage", lambda k, n: n >= 0))
