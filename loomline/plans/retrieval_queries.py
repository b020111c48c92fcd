"""Queries over vectors, rewards and relationship graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.session import table
from loomline.operators import graph, retrieval, reward


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def ir_topk_ranking(spark, d):
    """The five nearest vectors of every query vector (ids divisible by 20), itself left out, over all vectors."""
    vec = _vectors(spark, d)
    found = retrieval.top_k(vec, vec.where("vec_id % 20 = 0"), "vec_id", "vec_id", "v", 6).where("query != doc")
    rank = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    return found.withColumn("rank", rank).where("rank <= 5").select("query", "doc", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def ir_reranked(spark, d):
    """The 20 nearest by cosine (the vector itself among them), of which the three with the largest dot product."""
    vec = _vectors(spark, d)
    found = retrieval.top_k(vec, vec.where("vec_id % 20 = 0"), "vec_id", "vec_id", "v", 20)
    v = lambda c: vec.select(F.col("vec_id").alias(c), F.col("v").alias(f"{c}_v"))
    scores = found.join(v("query"), "query").join(v("doc"), "doc").select("query", "doc", F.round(retrieval.dot(F.col("query_v"), F.col("doc_v")), 5).alias("score"))
    return retrieval.rerank(found, scores, 3).select("query", "doc", F.round("score", 3).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def ir_pairwise_cosine(spark, d):
    """Cosine and dot product of each vector with the next one by id."""
    vec = _vectors(spark, d)
    near = vec.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return vec.join(near, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("v"), F.col("w")), 5).alias("cosine"), F.round(retrieval.dot(F.col("v"), F.col("w")), 4).alias("dot"))


def ir_rank_metrics(spark, d):
    """Metrics of finding, for each query vector, the first hit of its own label among its ten nearest others."""
    vec = _vectors(spark, d)
    found = retrieval.top_k(vec, vec.where("vec_id % 20 = 0"), "vec_id", "vec_id", "v", 11).where("query != doc")
    rank = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    found = found.withColumn("rank", rank).where("rank <= 10")
    label = lambda c: vec.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
    hits = found.join(label("doc"), "doc").join(label("query"), "query")
    first = hits.groupBy("query").agg(F.min(F.when(F.col("doc_label") == F.col("query_label"), F.col("rank"))).alias("rank"))
    return retrieval.metrics(first, "rank")


def retrieval_pairs(spark, d):
    """Anchor and positive texts of evaluation items with an answer."""
    items = table(spark, d, "eval_items").where("answer IS NOT NULL")
    anchor = F.concat(F.lit("Company: "), F.col("benchmark"), F.lit(" | Year: "), F.col("split_name"), F.lit(" | Question: "), F.col("text"))
    return items.select("item_id", anchor.alias("anchor"), F.col("answer").alias("positive"))


def pair_batches(spark, d):
    """Batches in which no anchor (an order's customer) occurs twice: how many, the largest, repeats inside."""
    rows = retrieval.batches_without_repeats(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 32)
    per = rows.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("k"))
    return per.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 32).alias("fits"), F.sum(F.col("n") - F.col("k")).alias("n_repeats"))


def _completions(spark, d):
    o = table(spark, d, "orders")
    words = F.array_join(F.array_repeat(F.lit("step"), (F.col("o_orderkey") % 90).cast("int")), " ")
    total = F.floor("o_totalprice").cast("bigint")
    said = F.when(F.col("o_orderkey") % 3 == 0, total).otherwise(total + 1)
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(words, F.lit(" no number"))).otherwise(F.concat(words, F.lit(" Answer: "), F.regexp_replace(said.cast("string"), r"(\d{3})$", ",$1")))
    return o.select("o_orderkey", F.col("o_custkey").alias("prompt"), text.alias("completion"), total.cast("string").alias("expected"))


def reward_scores(spark, d):
    c = F.col("completion")
    return _completions(spark, d).select("o_orderkey", reward.answer(c).alias("answer"), reward.correctness(c, F.col("expected")).alias("correct"), reward.form(c).alias("form"), reward.reasoning(c).alias("reasoning"))


def reward_group_advantage(spark, d):
    c = F.col("completion")
    rows = _completions(spark, d).withColumn("reward", F.round(reward.correctness(c, F.col("expected")) + reward.form(c) + reward.reasoning(c), 6))
    return reward.advantages(rows, "prompt", "reward").select("o_orderkey", "reward", (F.round("advantage", 5) + 0.0).alias("advantage"))


def _edges(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


def graph_supplier_bullets(spark, d):
    """Per supplier the first thirty parts it supplies, as a bullet list."""
    e = _edges(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    names = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "p_name"))), lambda x: x["p_name"])
    rows = e.groupBy("l_suppkey").agg(names.alias("names"))
    text = graph.bullets(F.col("names"), 30)
    return rows.select("l_suppkey", F.size("names").cast("bigint").alias("n_parts"), F.sha2(text, 256).alias("text_hash"))


def graph_two_hop_relations(spark, d):
    """Parts and the nations of the suppliers that supply them."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return _edges(spark, d).join(s, "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("s_nationkey").alias("n_nations"), F.min("s_nationkey").alias("first_nation"))


def title_names(spark, d):
    return table(spark, d, "source_trajectories").select("task").where("task IS NOT NULL").distinct().select("task", graph.title(F.col("task")).alias("title"))


def events_hourly_types(spark, d):
    """Extra coverage of the event table: tumbling hours per type."""
    ev = table(spark, d, "events")
    return ev.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_NEAR = "p AS (SELECT q.vec_id AS query, d.vec_id AS doc, d.label = q.label AS hit, list_cosine_similarity(q.v, d.v) AS score FROM v q JOIN v d ON q.vec_id != d.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc) AS rank FROM p)"
_METRIC = lambda k: f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6)"
_COMP = """c AS (SELECT o_orderkey, o_custkey AS prompt, floor(o_totalprice)::BIGINT AS total, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT ELSE floor(o_totalprice)::BIGINT + 1 END AS said,
  array_to_string(list_transform(range(0, o_orderkey % 90), lambda i: 'step'), ' ') AS words FROM orders),
t AS (SELECT o_orderkey, prompt, total::VARCHAR AS expected, CASE WHEN o_orderkey % 7 = 0 THEN words || ' no number' ELSE words || ' Answer: ' || regexp_replace(said::VARCHAR, '([0-9]{3})$', ',\\1') END AS completion FROM c),
s AS (SELECT o_orderkey, prompt, replace(regexp_extract(completion, 'Answer:\\s*([0-9,]+)', 1), ',', '') AS answer, expected,
  CASE WHEN regexp_matches(completion, 'Answer:\\s*[0-9]') THEN 0.2 ELSE 0.0 END::DOUBLE AS form,
  CASE WHEN len(list_filter(regexp_split_to_array(string_split(completion, 'Answer:')[1], '\\s+'), lambda w: w != '')) >= 50 THEN 0.1 ELSE 0.0 END::DOUBLE AS reasoning FROM t),
z AS (SELECT *, CASE WHEN answer = expected THEN 1.0 ELSE 0.0 END::DOUBLE AS correct FROM s)"""

def _bundle(spark, d):
    """A relationship bundle made from the warehouse tables: parts as techniques, suppliers as groups and software, orders' lines as uses, customers as mitigations."""
    lit = F.lit
    objs = lambda df, **cols: df.select(*[(cols[n] if n in cols else lit(None)).cast(t.dataType).alias(n) for n, t in ((f.name, f) for f in graph.OBJECT.fields)], cols["pos"].cast("bigint").alias("pos"))
    part, supp, cust, line = (table(spark, d, n) for n in ("part", "supplier", "customer", "lineitem"))
    k = F.col("p_partkey")
    refs = F.array(F.struct(lit("other").alias("source_name"), lit("x").alias("external_id")), F.struct(lit("mitre-attack").alias("source_name"), F.when(k % 17 != 0, F.concat(lit("T"), k)).alias("external_id")))
    phase = F.array(F.struct(lit("mitre-attack").alias("kill_chain_name"), F.lower(F.replace("p_brand", lit("#"), lit("-"))).alias("phase_name")), F.struct(lit("none").alias("kill_chain_name"), lit("x").alias("phase_name")))
    tech = objs(part, pos=k, id=F.concat(lit("attack-pattern--"), k), type=lit("attack-pattern"), name=F.col("p_name"), description=F.concat(lit(" Uses "), F.col("p_type"), lit(' "x".\n')), revoked=k % 11 == 0, external_references=refs, kill_chain_phases=phase, x_mitre_platforms=F.when(k % 3 != 0, F.array(F.col("p_brand"), F.concat(lit("Size "), F.col("p_size")))), x_mitre_data_sources=F.when(k % 4 == 0, F.array(F.concat(lit("Size "), F.col("p_size")))), x_mitre_detection=F.when(k % 5 != 0, F.concat(lit("Watch "), F.col("p_brand"))), x_mitre_is_subtechnique=k % 2 == 0)
    s_ = F.col("s_suppkey")
    grp = objs(supp, pos=s_ + 10_000_000, id=F.concat(F.when(s_ % 4 == 0, "malware--").otherwise("intrusion-set--"), s_), type=F.when(s_ % 4 == 0, "malware").otherwise("intrusion-set"), name=F.col("s_name"), description=F.concat(lit("Nation "), F.col("s_nationkey")), x_mitre_deprecated=s_ % 9 == 0, aliases=F.when(s_ % 2 == 0, F.array("s_name", lit("also"))), x_mitre_platforms=F.array(lit("Any")))
    c_ = F.col("c_custkey")
    mit = objs(cust, pos=c_ + 20_000_000, id=F.concat(lit("course-of-action--"), c_), type=lit("course-of-action"), name=F.col("c_name"))
    uses = line.select("l_suppkey", "l_partkey").distinct()
    rel = objs(uses, pos=F.col("l_suppkey") * 10_000_000 + F.col("l_partkey") + 100_000_000, id=F.concat_ws("--", lit("relationship"), "l_suppkey", "l_partkey"), type=lit("relationship"), relationship_type=lit("uses"), source_ref=F.concat(lit("intrusion-set--"), F.col("l_suppkey")), target_ref=F.concat(lit("attack-pattern--"), F.col("l_partkey")))
    stop = objs(cust, pos=c_ + 30_000_000, id=F.concat(lit("relationship--m"), c_), type=lit("relationship"), relationship_type=lit("mitigates"), source_ref=F.concat(lit("course-of-action--"), c_), target_ref=F.concat(lit("attack-pattern--"), c_))
    tac = objs(table(spark, d, "region"), pos=F.col("r_regionkey") + 40_000_000, id=F.concat(lit("x-mitre-tactic--"), F.col("r_regionkey")), type=lit("x-mitre-tactic"), name=F.col("r_name"), description=F.when(F.col("r_regionkey") != 2, F.concat(lit("Of "), F.col("r_name"))))
    return tech.union(grp).union(mit).union(rel).union(stop).union(tac)


def graph_examples(spark, d):
    """Instruction examples from the bundle: question and answer of each."""
    rows = graph.examples(_bundle(spark, d), "You know the matrix.")
    return rows.select("id", "kind", F.get("messages", F.lit(0))["content"].alias("system"), F.get("messages", F.lit(1))["content"].alias("question"), F.get("messages", F.lit(2))["content"].alias("answer"))


def graph_subtechniques(spark, d):
    return graph.subtechniques(_bundle(spark, d))


def graph_shuffled_examples(spark, d):
    """All examples in an order drawn by hash: position, id and kind."""
    return graph.shuffled(graph.examples(_bundle(spark, d), "x").select("id", "kind"), ["id", "kind"]).select("id", "kind", F.col("position").cast("bigint").alias("position"))


def ir_distractors(spark, d):
    """The corpus of an evaluation: the held-out vectors and, as distractors, the first 2,000 of the others, each once."""
    vec = _vectors(spark, d)
    return retrieval.with_distractors(vec.where("vec_id % 20 = 0"), vec.where("vec_id % 20 != 0"), ["vec_id"], 2000).select("vec_id", "is_distractor")


QUERIES = {f.__name__: f for f in (ir_reranked, graph_examples, graph_subtechniques, graph_shuffled_examples, ir_distractors, ir_topk_ranking, ir_pairwise_cosine, ir_rank_metrics, retrieval_pairs, pair_batches, reward_scores, reward_group_advantage, graph_supplier_bullets, graph_two_hop_relations, title_names, events_hourly_types)}
SQL = {
    "ir_topk_ranking": f"WITH {_V}, {_NEAR} SELECT query, doc, round(score, 5) AS score, rank FROM r WHERE rank <= 5",
    "ir_pairwise_cosine": f"WITH {_V} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) AS cosine, round(list_dot_product(a.v, b.v), 4) AS dot FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "ir_rank_metrics": f"WITH {_V}, {_NEAR}, f AS (SELECT query, min(rank) FILTER (hit) AS rank FROM r WHERE rank <= 10 GROUP BY query) SELECT count(*) AS n_queries, "
    + ", ".join(f"{_METRIC(k)} AS accuracy_at_{k}, round(avg(CASE WHEN rank <= {k} THEN 1.0 / {k} ELSE 0.0 END), 6) AS precision_at_{k}, {_METRIC(k)} AS recall_at_{k}" for k in (1, 3, 5, 10))
    + ", round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_at_10, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0.0 END), 6) AS mrr_at_10, round(avg(CASE WHEN rank <= 100 THEN 1 / rank ELSE 0.0 END), 6) AS map_at_100 FROM f",
    "retrieval_pairs": "SELECT item_id, 'Company: ' || benchmark || ' | Year: ' || split_name || ' | Question: ' || text AS anchor, answer AS positive FROM eval_items WHERE answer IS NOT NULL",
    "pair_batches": "SELECT count(*) AS n_rows, true AS fits, 0::BIGINT AS n_repeats FROM orders",
    "reward_scores": f"WITH {_COMP} SELECT o_orderkey, answer, correct, form, reasoning FROM z",
    "reward_group_advantage": f"WITH {_COMP}, w AS (SELECT o_orderkey, prompt, round(correct + form + reasoning, 6) AS reward FROM z) SELECT o_orderkey, reward, round(CASE WHEN stddev_pop(reward) OVER p > 1e-9 THEN (reward - avg(reward) OVER p) / stddev_pop(reward) OVER p ELSE 0.0 END, 5) + 0.0 AS advantage FROM w WINDOW p AS (PARTITION BY prompt)",
    "graph_supplier_bullets": "WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT l_suppkey, list(p_name ORDER BY l_partkey, p_name) AS names FROM e JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey) SELECT l_suppkey, len(names) AS n_parts, sha256(array_to_string(list_transform(names[1:30], lambda x: '- ' || x), chr(10))) AS text_hash FROM r",
    "graph_two_hop_relations": "SELECT l_partkey, count(DISTINCT s_nationkey) AS n_nations, min(s_nationkey) AS first_nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey",
    "title_names": "SELECT task, array_to_string(list_transform(string_split(replace(task, '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM (SELECT DISTINCT task FROM source_trajectories WHERE task IS NOT NULL)",
    "events_hourly_types": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

_TECH = """tech AS (SELECT p_partkey AS k, 'attack-pattern--' || p_partkey AS id, p_name AS name, 'T' || p_partkey AS tid, 'Uses ' || p_type || ' "x".' AS descr, p_partkey % 11 = 0 AS gone, p_partkey % 17 != 0 AS known,
  array_to_string(list_transform(string_split(replace(lower(replace(p_brand, '#', '-')), '-', ' '), ' '), lambda x: upper(x[1]) || substr(x, 2)), ' ') AS tactic, CASE WHEN p_partkey % 3 != 0 THEN p_brand || ', Size ' || p_size ELSE 'various platforms' END AS plats,
  CASE WHEN p_partkey % 3 != 0 THEN [p_brand, 'Size ' || p_size] ELSE [] END AS plat_list, CASE WHEN p_partkey % 4 = 0 THEN ['Size ' || p_size] ELSE [] END AS data, CASE WHEN p_partkey % 5 != 0 THEN 'Watch ' || p_brand ELSE '' END AS detect, p_partkey % 2 = 0 AS sub FROM part),
mit AS (SELECT c_custkey AS k, c_name AS mit FROM customer), t AS (SELECT tech.*, mit FROM tech LEFT JOIN mit USING (k) WHERE NOT gone AND known),
grp AS (SELECT *, s_suppkey % 4 = 0 AS soft FROM supplier WHERE s_suppkey % 9 != 0),
uses AS (SELECT l_suppkey AS s, list(p_name ORDER BY l_partkey)[:30] AS names FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey),
ex AS (SELECT id, 'explain' AS kind, 'Explain the ATT&CK technique ' || name || ' (' || tid || ').' AS question, descr || chr(10) || chr(10) || '**Tactic(s):** ' || tactic || chr(10) || '**Platforms:** ' || plats AS answer FROM t
UNION ALL SELECT id, 'detect', 'How can defenders detect ' || name || ' (' || tid || ')?', detect || CASE WHEN len(data) > 0 THEN chr(10) || '**Data sources:** ' || array_to_string(data, ', ') ELSE '' END FROM t WHERE detect != ''
UNION ALL SELECT id, 'json', 'Return a structured JSON summary for ATT&CK technique ' || name || ' (' || tid || ').', '{' || chr(10) || '  "tactic": "' || tactic || '",' || chr(10) || '  "technique_id": "' || tid || '",' || chr(10) || '  "technique_name": "' || name || '",' || chr(10) || '  "is_subtechnique": ' || sub || ',' || chr(10) || '  "platforms": ' || JLIST(plat_list) || ',' || chr(10) || '  "summary": "' || replace(descr, '"', chr(92) || '"') || '",' || chr(10) || '  "recommended_detection": "' || detect || '",' || chr(10) || '  "data_sources": ' || JLIST(data) || ',' || chr(10) || '  "recommended_mitigation": ' || JLIST(CASE WHEN mit IS NULL THEN [] ELSE [mit] END) || chr(10) || '}' FROM t
UNION ALL SELECT id, 'mitigate', 'What mitigations apply to ' || name || ' (' || tid || ')?', '- ' || mit FROM t WHERE mit IS NOT NULL
UNION ALL SELECT 'intrusion-set--' || s_suppkey, 'group', 'Who is the threat group ' || s_name || '?', 'Nation ' || s_nationkey || chr(10) || chr(10) || '**Also known as:** ' || CASE WHEN s_suppkey % 2 = 0 THEN s_name || ', also' ELSE 'none known' END FROM grp WHERE NOT soft
UNION ALL SELECT 'intrusion-set--' || s_suppkey, 'uses', 'What ATT&CK techniques does ' || s_name || ' use?', '- ' || array_to_string(names, chr(10) || '- ') FROM grp JOIN uses ON uses.s = s_suppkey WHERE NOT soft
UNION ALL SELECT 'malware--' || s_suppkey, 'software', 'What is the malware known as ' || s_name || '?', 'Nation ' || s_nationkey || chr(10) || chr(10) || '**Platforms:** Any' FROM grp WHERE soft
UNION ALL SELECT 'x-mitre-tactic--' || r_regionkey, 'tactic', 'Describe the ATT&CK tactic: ' || r_name || '.', 'Of ' || r_name FROM region WHERE r_regionkey != 2)"""
for _list in ("plat_list", "data", "CASE WHEN mit IS NULL THEN [] ELSE [mit] END"):
    _TECH = _TECH.replace(f"JLIST({_list})", f"CASE WHEN len({_list}) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform({_list}, lambda x: chr(10) || '    \"' || x || '\"'), ',') || chr(10) || '  ]' END")
SQL |= {
    "graph_examples": f"WITH {_TECH} SELECT id, kind, 'You know the matrix.' AS system, question, answer FROM ex",
    "graph_subtechniques": f"WITH {_TECH} SELECT count(*) AS n_techniques, count(*) FILTER (sub) AS n_subtechniques FROM tech WHERE NOT gone",
    "graph_shuffled_examples": f"WITH {_TECH} SELECT id, kind, row_number() OVER (ORDER BY sha256('shuffle42' || chr(0) || id || chr(0) || kind), id, kind) - 1 AS position FROM ex",
    "ir_reranked": """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query, vec_id AS doc, round(list_dot_product(qv, embedding::DOUBLE[]), 5) AS s, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 12) AS c FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(qv, embedding::DOUBLE[]), 12) DESC, vec_id) <= 20)
SELECT query, doc, round(s, 3) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) <= 3""",
    "ir_distractors": "SELECT vec_id, false AS is_distractor FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT * FROM (SELECT vec_id, true FROM embeddings WHERE vec_id % 20 != 0 ORDER BY vec_id LIMIT 2000)",
}
