"""Prompts as column expressions. The texts around the columns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.functions import text as X


def first_text(*columns: Column) -> Column:
    """The first value that isn't blank, stripped; '' if none."""
    return F.coalesce(*[F.nullif(X.strip(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def ordered_json(c: Column) -> Column:
    """A conversation as compact JSON in the order content, role."""
    return conv.canonical_json(c)


def refinement(task: Column, index: Column, conversations: Column) -> Column:
    parts = [F.lit("Task identifier: "), task, F.lit("\nRefinement index: "), index.cast("string"), F.lit("\n\nOriginal conversation JSON:\n"), ordered_json(conversations), F.lit("\n\nReturn a refined conversation for the same task.")]
    return F.concat(*parts)


def synthesis(instruction: Column, environment: Column, framing: Column) -> Column:
    lead = F.coalesce(F.concat(F.nullif(X.strip(framing), F.lit("")), F.lit("\n\n")), F.lit(""))
    place = F.coalesce(F.nullif(environment, F.lit("")), F.lit("Generic Ubuntu 22.04 container."))
    return F.concat(F.lit("## Task\n"), lead, instruction, F.lit("\n\n## Environment\n"), place, F.lit("\n\nSynthesize a complete, realistic agent trajectory that solves this task."))


def batch_sources(requests: DataFrame) -> DataFrame:
    """Per batch its distinct sources and its requests: one source is sent once however many requests name it.

    ``requests``: batch_id, synthetic_id, source_record_id, refinement_index, fingerprint (null: not known). A record id with two fingerprints in a batch is an error.
    """
    sources = requests.groupBy("batch_id", "source_record_id").agg(F.countDistinct("fingerprint").alias("_n"), F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n_requests"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("a record has two contents in a batch")).cast("string")).otherwise(F.col("fingerprint"))
    return sources.select("batch_id", "source_record_id", checked.alias("fingerprint"), "n_requests")
