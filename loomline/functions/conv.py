"""Column expressions over conversations: ARRAY<STRUCT<content, role>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X

ROLES = ("system", "user", "assistant", "tool")
ALIASES = {"tool_result": "tool", "observation": "tool"}
TASK_MARK, STATE_MARK = "Task Description:\n", "\n\nCurrent terminal state:"  # fixed values
CONVERSATION = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("role", T.StringType())]))


def assemble(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """One conversation per key from a row per turn. A conversation must fit a row, as it does in its table."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("content"), F.col(role).alias("role")))).alias("t"))
    return rows.select(key, F.transform("t", lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role"))).alias("conversations"))


def contents(c: Column) -> Column:
    """Contents in order, null as ''."""
    return F.transform(c, lambda t: F.coalesce(t["content"], F.lit("")))


def joined(c: Column, roles: tuple[str, ...] | None = None, by: str = "\n") -> Column:
    if roles:
        c = F.filter(c, lambda t: t["role"].isin(*roles))
    return F.array_join(contents(c), by)


def role_letters(c: Column) -> Column:
    """Roles as one letter each: s, u, a, t."""
    return F.array_join(F.transform(c, lambda t: F.substring(F.coalesce(t["role"], F.lit("?")), 1, 1)), "")


def problem(c: Column, blank_ok: bool = False, any_final: bool = False, least: int = 2, most: int | None = 40) -> Column:
    """The first rule a conversation breaks, or null: ``turns``, ``role``, ``content``, ``blank``, ``final``."""
    n = F.size(c)
    bad = F.when(c.isNull() | (n < least) | (F.lit(most is not None) & (n > (most or 0))), "turns")
    bad = bad.when(F.exists(c, lambda t: t.isNull() | ~F.coalesce(t["role"], F.lit("")).isin(*ROLES)), "role")
    bad = bad.when(F.exists(c, lambda t: t["content"].isNull()), "content")
    if not blank_ok:
        bad = bad.when(F.exists(c, lambda t: X.is_blank(t["content"])), "blank")
    if not any_final:
        bad = bad.when(F.element_at(c, -1)["role"] != "assistant", "final")
    return bad


def canonical_json(c: Column) -> Column:
    """Compact JSON with sorted keys, the text that fingerprints are taken of."""
    turn = lambda t: F.concat(F.lit('{"content":"'), X.json_escape(F.coalesce(t["content"], F.lit(""))), F.lit('","role":"'), X.json_escape(F.coalesce(t["role"], F.lit(""))), F.lit('"}'))
    return F.concat(F.lit("["), F.array_join(F.transform(c, turn), ","), F.lit("]"))


def fingerprint(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def legacy_normal(c: Column) -> Column:
    """Lossy form: role aliases, contents stripped; null if a role is unknown."""
    role = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[X.strip(t["role"])], X.strip(t["role"]))
    out = F.transform(c, lambda t: F.struct(X.strip(F.coalesce(t["content"], F.lit(""))).alias("content"), role(t).alias("role")))
    return F.when(F.exists(out, lambda t: ~F.coalesce(t["role"], F.lit("")).isin(*ROLES)), F.lit(None)).otherwise(out)


def legacy_fingerprint(c: Column) -> Column:
    """Hash of the contents whatever their case and white space."""
    text = F.array_join(F.transform(contents(c), lambda x: F.lower(X.strip(x))), " ")
    return F.sha2(F.regexp_replace(text, rf"{X.WS}+", " "), 256)


def is_structural(c: Column) -> Column:
    """2 to 40 turns, at least 50 characters, none of the phrases of a model that did nothing."""
    text = joined(c, by=" ")
    return F.coalesce(F.size(c).between(2, 40) & ~text.rlike(X.DEGENERATE) & (F.length(X.strip(text)) >= 50), F.lit(False))


def instruction(c: Column) -> Column:
    """The task in the first user turn, between its two marks; '' where there is none."""
    first = F.get(c, F.lit(0))
    text = F.coalesce(first["content"], F.lit(""))
    at = F.locate(TASK_MARK, text)
    rest = F.substr(text, at + len(TASK_MARK))
    end = F.locate(STATE_MARK, rest)
    task = F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.when((first["role"] == "user") & (at > 0), X.strip(task)).otherwise("")


def last_assistant(c: Column) -> Column:
    turns = F.filter(c, lambda t: t["role"] == "assistant")
    return F.coalesce(F.try_element_at(contents(turns), F.lit(-1)), F.lit(""))
