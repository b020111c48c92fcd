"""Queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import cut, table
from loomline.llm import components, leakage, neardup, packing, pairs, repetition, residue, truncation


def conversation_text(conversations: str = "conversations"):
    """Contents of all turns in order, one per line; words never run across turns."""
    return F.array_join(F.col(f"{conversations}.content"), "\n")


# 2: broken prompt and answer pairs


def _p2(spark: SparkSession, d: str) -> DataFrame:
    refined = pairs.records(table(spark, d, "refined_rows"), "refined_rows", F.col("run_id"), "conversations", F.col("trace_source"))
    mitre = pairs.records(table(spark, d, "mitre_sft"), "mitre_sft", F.col("sample_id"), "messages", F.lit(""))  # one source
    return pairs.broken_pairs(refined.unionByName(mitre))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("table_name", "record_id", "turn_index", "defect").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Defects per table."""
    return _p2(spark, d).groupBy("table_name", "defect").agg(F.count("*").alias("n_pairs"))


# 3: repetition inside one document


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "refined_rows")
    return repetition.repetition_shares(rows, "run_id", conversation_text(), {"trace_source": F.col("trace_source")}).distinct()


def _p3(spark: SparkSession, d: str, ceiling: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Shares of the conversations, and cutoffs from trials generated from all of them; no cutoff looks at a conversation's own share."""
    rows, source = table(spark, d, "refined_rows"), F.coalesce("trace_source", F.lit("(null)"))
    per = repetition.trials_per_row(rows, source, 8, 0.01, 0.05, ceiling)
    per = cut(per.withColumnRenamed("stratum", "__stratum"))  # a row a source
    rows = rows.join(F.broadcast(per) if per.count() <= 10_000 else per, source == F.col("__stratum"))
    shares = cut(repetition.repetition_shares(rows, "run_id", conversation_text(), {"trace_source": F.col("trace_source")}, trials=F.col("trials")))
    labelled = shares.select("trace_source", F.explode("trials").alias("t")).select("trace_source", "t.*")
    return shares.drop("trials"), repetition.risk_cutoffs(labelled, "trace_source", "share", "bad", ceiling=ceiling)


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d)[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    shares, cutoffs = _p3(spark, d)
    return repetition.flag_repetitive(shares, cutoffs, "trace_source").where("flagged").select("run_id").distinct()


# 4: text cut off


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_turns(table(spark, d, "refined_rows"), "run_id", "conversations", "trace_source").where("reason IS NOT NULL")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select(F.col("id").alias("run_id"), "turn_index").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per trace_source: turns, cut turns, their share and how they were recognised."""
    rows = table(spark, d, "refined_rows")
    turns = rows.select("run_id", F.coalesce("trace_source", F.lit("(null)")).alias("trace_source"), F.size("conversations").alias("n")).distinct().groupBy("trace_source").agg(F.sum("n").alias("n_turns"))
    cut_ = _p4(spark, d).groupBy(F.coalesce("source", F.lit("(null)")).alias("trace_source"))
    count = lambda reason: F.count_if(F.col("reason") == reason).alias(f"by_{reason}")
    cut_ = cut_.agg(F.count("*").alias("n_cut"), *[count(r) for r in ("limit", "form", "longer_copy", "phrase")])
    out = turns.join(cut_, "trace_source", "left").fillna(0)
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_turns"), 6))


# 5: near-duplicate conversations


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "refined_rows"), "run_id", conversation_text(), n=3, threshold=0.6)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.id_pairs(*_p5(spark, d))
    return pairs.select(F.col("id_a").alias("run_id_a"), F.col("id_b").alias("run_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation in a class: run_id, class of equal shingle sets, group of linked classes, links of the class."""
    members, links = _p5(spark, d)
    links = cut(links)
    groups = components.components(links, "class_a", "class_b").select(F.col("id").alias("class"), "component")
    ends = links.select(F.col("class_a").alias("class")).union(links.select("class_b")).groupBy("class").agg(F.count("*").alias("n_links"))
    out = members.join(groups, "class", "left").join(ends, "class", "left")
    return out.select(F.col("id").alias("run_id"), "class", F.coalesce("component", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


# 6: filling containers


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "packing_profiles"), "doc_id", packing.pretoken_count(F.col("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1").select("profile_id", "doc_id").distinct()


def p6_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).drop("capacity")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: items, containers, the least possible number of them, and the fill rate."""
    bins = _packed(spark, d).groupBy("profile_id", "capacity", "container").agg(F.sum("cost").alias("used"), F.count("*").alias("items"))
    out = bins.groupBy("profile_id", "capacity").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return out.withColumns({"least": F.ceil(F.col("used") / F.col("capacity")), "fill_rate": F.round(F.col("used") / (F.col("containers") * F.col("capacity")), 6)})


# 7: evaluation texts in the corpus


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: documents they appear in and the longest passage in words."""
    words = F.col("last_word") - F.col("first_word") + 1
    return _spans(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max(words).alias("longest_words"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_spans(table(spark, d, "documents"), cut(_spans(spark, d)))


# 8: template residue and error pages


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), every=True).select("doc_id", "residue_kind")


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Residue per source and kind, and how it was recognised."""
    docs = table(spark, d, "documents")
    found = residue.residue(docs, every=True)
    return found.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source", "residue_kind", "how").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_shares, p3_cutoffs, p4_found, p4_rates, p5_found, p5_groups, p6_found, p6_assignments, p6_fill, p7_found, p7_items, p7_cleaned, p8_found, p8_by_source)}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_REFINED_WORDS = (
    "WITH w AS (SELECT DISTINCT run_id, trace_source, "
    + _WORDS.format("list_aggregate(list_transform(conversations, lambda x: coalesce(x.content, '')), 'string_agg', chr(10))")
    + " AS w FROM refined_rows)"
)
_P3 = _REFINED_WORDS + """,
g AS (SELECT run_id, trace_source, len(w) AS n, unnest(range(1, len(w) - 2)) AS i, w FROM w),
s AS (SELECT run_id, trace_source, n, i, row_number() OVER (PARTITION BY run_id, array_to_string(w[i:i + 3], ' ') ORDER BY i) AS k FROM g),
p AS (SELECT DISTINCT run_id, i + j AS at FROM s, range(0, 4) t(j) WHERE k > 1),
c AS (SELECT run_id, count(*) AS again FROM p GROUP BY run_id),
shares AS (SELECT w.run_id, w.trace_source, len(w.w) AS n_words, coalesce(again, 0) AS n_repeated FROM w LEFT JOIN c ON c.run_id = w.run_id)
"""

_NONSPACE = r"""'''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+'"""
# white space: a token where a run of two or more begins, where its last character isn't a blank, or at the end
_P6_SIZE = (
    f"len(regexp_extract_all(text, {_NONSPACE})) + len(regexp_extract_all(text, '\\s\\s+\\S'))"
    " + len(regexp_extract_all(text, '[\\t\\n\\f\\r]\\S')) + len(regexp_extract_all(text, '\\s+$'))"
)

SQL: dict[str, str] = {
    "p3_shares": _P3 + "SELECT run_id, trace_source, n_words, n_repeated, CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0 END AS share FROM shares",
    "p3_found": _P3 + "SELECT run_id FROM shares WHERE n_words > 0 AND n_repeated * 5 >= n_words * 2",
    "p6_found": f"SELECT p.profile_id, d.doc_id FROM (SELECT doc_id, {_P6_SIZE} AS size FROM documents) d, packing_profiles p WHERE d.size + p.separator_tokens > p.capacity_tokens",
    "p7_found": "WITH d AS (SELECT doc_id, " + _WORDS.format("text") + " AS w FROM documents), "
    "e AS (SELECT item_id, " + _WORDS.format("text") + " AS w FROM eval_items), "
    "dg AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)), "
    "eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e)) "
    "SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
}

SQL["p7_items"] = (
    "WITH d AS (SELECT DISTINCT doc_id, " + _WORDS.format("text") + " AS w FROM documents), "
    "e AS (SELECT item_id, " + _WORDS.format("text") + " AS w FROM eval_items), "
    "dg AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)), "
    "eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e)), "
    "hit AS (SELECT DISTINCT doc_id, item_id, i FROM dg JOIN eg USING (g)), "
    "mark AS (SELECT *, CASE WHEN i > lag(i, 1, -99) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 13 THEN 1 ELSE 0 END AS new FROM hit), "
    "run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM mark), "
    "span AS (SELECT doc_id, item_id, max(i) - min(i) + 13 AS n FROM run GROUP BY doc_id, item_id, r) "
    "SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n) AS longest_words FROM span GROUP BY item_id"
)
SQL["p5_found"] = _REFINED_WORDS + """,
g AS (SELECT DISTINCT run_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT run_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT run_id, count(*) AS n FROM g GROUP BY run_id),
m AS (SELECT x.run_id AS a, y.run_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.run_id < y.run_id GROUP BY ALL)
SELECT a AS run_id_a, b AS run_id_b FROM m JOIN n p ON p.run_id = a JOIN n q ON q.run_id = b WHERE k >= 0.6 * (p.n + q.n - k)
"""
