"""A relationship graph as vertices and edges, and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X

_REF = T.ArrayType(T.StructType([T.StructField("source_name", T.StringType()), T.StructField("external_id", T.StringType())]))
_PHASE = T.ArrayType(T.StructType([T.StructField("kill_chain_name", T.StringType()), T.StructField("phase_name", T.StringType())]))
_S, _L, _B = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType()
OBJECT = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", _S), ("type", _S), ("name", _S), ("description", _S), ("revoked", _B), ("x_mitre_deprecated", _B), ("aliases", _L), ("external_references", _REF),
        ("kill_chain_phases", _PHASE), ("x_mitre_platforms", _L), ("x_mitre_data_sources", _L), ("x_mitre_detection", _S), ("x_mitre_is_subtechnique", _B),
        ("x_mitre_shortname", _S), ("relationship_type", _S), ("source_ref", _S), ("target_ref", _S),
    )]
)


def objects(spark, path: str) -> DataFrame:
    """The objects of a bundle document with their position in it."""
    doc = spark.read.schema(T.StructType([T.StructField("objects", T.ArrayType(OBJECT))])).option("multiLine", True).json(path)
    return doc.select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")


def vertices(objs: DataFrame) -> DataFrame:
    """One vertex per id; the last object of an id counts."""
    rest = [c for c in objs.columns if c != "id"]
    return objs.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*rest), "pos").alias("v")).select("id", "v.*")


def active(objs: DataFrame) -> DataFrame:
    return objs.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))


def neighbours(edges: DataFrame, verts: DataFrame, near: str, far: str, kind: str, far_type: str | None = None) -> DataFrame:
    """(id, names): the names at the far end of edges of a kind, in the order of the edges."""
    e = edges.where(F.col("relationship_type") == kind).select(F.col(near).alias("id"), F.col(far).alias("_far"), "pos")
    v = verts.where(F.col("type") == far_type) if far_type else verts
    names = e.join(v.select(F.col("id").alias("_far"), F.coalesce("name", F.lit("")).alias("name")), "_far")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return names.groupBy("id").agg(listed.alias("names"))


def listed(c: Column, default: str) -> Column:
    """Names with commas between them, or the default."""
    return F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(default))


def bullets(c: Column, most: int | None = None) -> Column:
    items = F.slice(c, 1, most) if most else c
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def attack_id(refs: Column) -> Column:
    return F.get(F.filter(refs, lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]


def _text(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), X.json_escape(c), F.lit('"')), F.lit("null"))


def _list(c: Column) -> Column:
    items = F.transform(c, lambda x: F.concat(F.lit("\n    "), _text(x)))
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("\n  ]"))).otherwise("[]")


def pretty(*fields: tuple[str, Column]) -> Column:
    """A JSON object indented by two blanks, its fields in the order given: each (name, JSON text)."""
    lines = [x for k, (name, c) in enumerate(fields) for x in (F.lit(f'{"," if k else ""}\n  "{name}": '), c)]
    return F.concat(F.lit("{"), *lines, F.lit("\n}"))


def subtechniques(objs: DataFrame) -> DataFrame:
    """One row: techniques and how many of them are sub-techniques."""
    tech = active(objs).where("type = 'attack-pattern'")
    return tech.agg(F.count("*").alias("n_techniques"), F.count_if(F.coalesce("x_mitre_is_subtechnique", F.lit(False))).alias("n_subtechniques"))


def shuffled(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Rows with a position drawn by hash: the same order each time, whatever the partitioning."""
    from loomline.operators.slots import numbered

    return numbered(rows.withColumn("_h", F.sha2(F.concat_ws("\x00", F.lit(f"shuffle{seed}"), *key), 256)), ["_h", *key]).drop("_h")


def examples(objs: DataFrame, system: str) -> DataFrame:
    """(id, kind, messages): instruction examples of techniques, groups, software and tactics. Their wording is a fixed value."""
    verts, edges = vertices(objs), objs.where("type = 'relationship'")
    live = active(objs.where("id IS NOT NULL")).withColumn("desc", X.strip(F.coalesce("description", F.lit("")))).where("desc != ''")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = lambda ask, answer: F.array(turn("system", F.lit(system)), turn("user", ask), turn("assistant", answer))
    fmt = lambda f, *c: F.format_string(f, *c)

    mits = neighbours(edges, verts, "target_ref", "source_ref", "mitigates").withColumnRenamed("names", "mits")
    phases = F.transform(F.filter(F.coalesce("kill_chain_phases", F.array().cast(_PHASE)), lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: title(p["phase_name"]))
    tech = live.where("type = 'attack-pattern'").withColumn("tid", attack_id(F.col("external_references"))).where("tid IS NOT NULL AND tid != ''").join(mits, "id", "left")
    name, tid = F.coalesce("name", F.lit("")), F.col("tid")
    plats, tacs = listed(F.col("x_mitre_platforms"), "various platforms"), listed(phases, "unknown tactic")
    detect = X.strip(F.coalesce("x_mitre_detection", F.lit("")))
    note = F.coalesce(F.concat(F.lit("\n**Data sources:** "), F.nullif(F.array_join("x_mitre_data_sources", ", "), F.lit(""))), F.lit(""))
    sub = F.when(F.coalesce("x_mitre_is_subtechnique", F.lit(False)), "true").otherwise("false")
    # fixed values: the keys of the summary and their order
    doc = pretty(
        ("tactic", _text(tacs)), ("technique_id", _text(tid)), ("technique_name", _text(name)), ("is_subtechnique", sub), ("platforms", _list(F.col("x_mitre_platforms"))), ("summary", _text(F.col("desc"))),
        ("recommended_detection", _text(detect)), ("data_sources", _list(F.col("x_mitre_data_sources"))), ("recommended_mitigation", _list(F.col("mits"))),
    )
    one = lambda kind, ask, answer, when=None: (s if when is None else F.when(when, s)) if (s := F.struct(F.lit(kind).alias("kind"), chat(ask, answer).alias("messages"))) is not None else None
    of_tech = [
        one("explain", fmt("Explain the ATT&CK technique %s (%s).", name, tid), fmt("%s\n\n**Tactic(s):** %s\n**Platforms:** %s", F.col("desc"), tacs, plats)),
        one("detect", fmt("How can defenders detect %s (%s)?", name, tid), F.concat(detect, note), detect != ""),
        one("json", fmt("Return a structured JSON summary for ATT&CK technique %s (%s).", name, tid), doc),
        one("mitigate", fmt("What mitigations apply to %s (%s)?", name, tid), bullets(F.col("mits")), F.size("mits") > 0),
    ]
    out = tech.select("id", F.inline(F.array_compact(F.array(*of_tech))))

    uses = neighbours(edges, verts, "source_ref", "target_ref", "uses", "attack-pattern").withColumnRenamed("names", "uses")
    group = live.where("type = 'intrusion-set'").join(uses, "id", "left")
    of_group = [
        one("group", fmt("Who is the threat group %s?", name), fmt("%s\n\n**Also known as:** %s", F.col("desc"), listed(F.col("aliases"), "none known"))),
        one("uses", fmt("What ATT&CK techniques does %s use?", name), bullets(F.col("uses"), 30), F.size("uses") > 0),
    ]
    out = out.unionByName(group.select("id", F.inline(F.array_compact(F.array(*of_group)))))
    kind = F.when(F.col("type") == "malware", "malware").otherwise("tool")
    soft = live.where("type IN ('malware', 'tool')").select("id", F.lit("software").alias("kind"), chat(fmt("What is the %s known as %s?", kind, name), fmt("%s\n\n**Platforms:** %s", F.col("desc"), plats)).alias("messages"))
    tactic = live.where("type = 'x-mitre-tactic'").select("id", F.lit("tactic").alias("kind"), chat(fmt("Describe the ATT&CK tactic: %s.", name), F.col("desc")).alias("messages"))
    return out.unionByName(soft).unionByName(tactic)


def chat_text(messages: Column) -> Column:
    """A plain chat template: each message under its role."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")))), "\n")
