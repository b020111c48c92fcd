"""The deterministic quality policy as column expressions: codes of a candidate against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.functions import text as X

# Fixed values of the policy.
LEAST_LONG, LEAST_EXECUTION, WEAK = 0.05, 0.15, 0.25


def _list(*codes: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in codes]))


def parts(source: Column, candidate: Column, with_anchors: bool = True) -> dict[str, Column]:
    """What the policy looks at, by name. As columns of their own (``prepared``) each is computed once a row."""
    asked = conv.joined(source, ("user",))
    own, done = conv.joined(candidate, ("user",)), conv.joined(candidate, ("assistant", "tool"))
    out = {
        "letters": conv.role_letters(candidate),
        "final": conv.last_assistant(candidate),
        "keys": F.transform(conv.contents(candidate), X.content_key),
        "text": conv.joined(candidate, ("user", "assistant")),
        "want": X.tokens(asked),
        "got": X.tokens(own),
        "executed": X.tokens(done),
        "same": conv.canonical_json(source) == conv.canonical_json(candidate),
        "invalid": conv.problem(source, blank_ok=True, any_final=True, least=1, most=None).isNotNull() | conv.problem(candidate, any_final=True).isNotNull(),
    }
    out["sequence"] = X.token_sequence(out["text"])
    if with_anchors:
        out |= {"exact": X.anchors(asked), "found": X.anchors(F.concat(own, F.lit("\n"), done))}
    return out


def prepared(df: DataFrame, source: str, candidate: str, with_anchors: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the parts as columns, and these."""
    own = parts(F.col(source), F.col(candidate), with_anchors)
    return df.withColumns({f"_q_{n}": c for n, c in own.items()}), {n: F.col(f"_q_{n}") for n in own}


def _degenerate(p: dict[str, Column]) -> list[tuple[str, Column]]:
    keys, seq = p["keys"], p["sequence"]
    n, distinct = F.size(keys), F.array_distinct(keys)
    adjacent = F.exists(F.zip_with(keys, F.slice(keys, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    return [
        ("candidate repeats adjacent turn content", adjacent),
        ("candidate repeats the same content three times", F.exists(distinct, lambda k: F.size(F.filter(keys, lambda x: x == k)) >= 3)),
        ("candidate has insufficient turn diversity", (n >= 6) & (F.size(distinct) / n < 0.5)),
        ("candidate contains too little task information", (F.size(seq) < 4) | (F.length(X.strip(p["text"])) < 24)),
        ("candidate content is excessively repetitive", (F.size(seq) >= 8) & (F.size(F.array_distinct(seq)) / F.size(seq) < 0.25)),
    ]


def _share(c: Column) -> Column:
    return F.format_string("%.3f", F.bround(c, 3))


def _drift(p: dict[str, Column]) -> list[tuple[Column, Column]]:
    n, both = F.size(p["want"]), F.size(F.array_intersect(p["want"], p["got"]))
    kept, executed = X.share_kept(p["want"], p["got"]), X.share_kept(p["want"], p["executed"])
    out = [
        (F.concat(F.lit("source-task token retention "), _share(kept), F.lit(" is below policy")), (n > 0) & ((both == 0) | ((n >= 20) & (kept < LEAST_LONG)))),
        (F.concat(F.lit("assistant/tool task-token retention "), _share(executed), F.lit(" is below policy")), (n >= 5) & (executed < LEAST_EXECUTION)),
    ]
    if "exact" in p:
        exact = p["exact"]
        out.append((F.lit("candidate loses every required high-signal task anchor"), (F.size(exact) > 0) & (F.size(F.array_intersect(exact, p["found"])) == 0) & ((F.size(exact) >= 2) | (kept < WEAK))))
    return out


def _refuses(p: dict[str, Column]) -> Column:
    return p["final"].rlike(X.REFUSAL) & (F.size(X.token_sequence(p["final"])) <= 80)


def _any(conditions: list) -> Column:
    out = F.lit(False)
    for _, cond in conditions:
        out = out | F.coalesce(cond, F.lit(False))
    return out


def codes_of(p: dict[str, Column]) -> Column:
    """Codes in the order they are raised, each once; ``invalid_conversation`` alone if a side has no valid form."""
    letters = p["letters"]
    out = _list(
        ("missing_participant", ~letters.contains("u") | ~letters.contains("a")),
        ("invalid_turn_order", ~letters.endswith("a")),
        # a block of tool turns needs an assistant before and after it
        ("orphan_tool", letters.rlike("(^|[su])t|t($|[su])")),
        ("refusal_only", _refuses(p)),
        ("degenerate_content", _any(_degenerate(p))),
        ("task_drift", _any(_drift(p))),
        ("unchanged_conversation", p["same"]),
    )
    return F.when(p["invalid"], F.array(F.lit("invalid_conversation"))).otherwise(out)


def codes(source: Column, candidate: Column, with_anchors: bool = True) -> Column:
    return codes_of(parts(source, candidate, with_anchors))


def issues_of(p: dict[str, Column]) -> Column:
    """array<struct<code, detail>>: each code once, in order, with all that speaks for it (fixed texts), joined by "; ".

    A side without a valid form gives ``invalid_conversation`` alone.
    """
    letters = p["letters"]
    index = F.filter(F.sequence(F.lit(0), F.length(letters) - 1), lambda i: F.substr(letters, i + 1, F.lit(1)) == "t")
    before = lambda i: F.substr(letters, F.lit(1), i).rlike("at*$")
    after = lambda i: F.substr(letters, i + 2).rlike("^t*a")
    orphans = F.flatten(F.transform(index, lambda i: F.array_compact(F.array(
        F.when(~before(i), F.concat(F.lit("tool block beginning near turn "), i.cast("string"), F.lit(" has no assistant invocation"))),
        F.when(~after(i), F.concat(F.lit("tool block ending near turn "), i.cast("string"), F.lit(" has no assistant interpretation"))),
    ))))
    when = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), what if isinstance(what, Column) else F.lit(what)) for what, cond in pairs]))
    found = [
        ("missing_participant", when([("candidate must contain at least one user and one assistant turn", ~letters.contains("u") | ~letters.contains("a"))])),
        ("invalid_turn_order", when([("candidate must end with an assistant interpretation or summary", ~letters.endswith("a"))])),
        ("orphan_tool", orphans),
        ("refusal_only", when([("candidate ends in a refusal or generic failure", _refuses(p))])),
        ("degenerate_content", when(_degenerate(p))),
        ("task_drift", when(_drift(p))),
        ("unchanged_conversation", when([("refined conversation is identical to the source conversation", p["same"])])),
    ]
    each = []
    for code, details in found:
        detail = F.array_join(F.array_distinct(details), "; ")
        each.append(F.when(detail != "", F.struct(F.lit(code).alias("code"), detail.alias("detail"))))
    bad = F.array(F.struct(F.lit("invalid_conversation").alias("code"), F.lit("").alias("detail")))
    return F.when(p["invalid"], bad).otherwise(F.array_compact(F.array(*each)))


def issues(source: Column, candidate: Column) -> Column:
    return issues_of(parts(source, candidate))


def error_text(found: Column) -> Column:
    """Issues as the text of an attempt's error."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["code"], F.lit(": "), x["detail"])), "; ")


def secondary_codes(source: Column, candidate: Column) -> Column:
    """Codes of the second policy, which only warns."""
    letters, final = conv.role_letters(candidate), conv.last_assistant(candidate)
    ask, asked = F.lower(conv.joined(candidate, ("user",), " ")), F.lower(conv.joined(source, ("user",), " "))
    added = F.lit(False)
    for forms in X.DELIVERABLES.values():
        pattern = r"(?U)\b(?:" + "|".join(forms) + r")\w*\b"
        added = added | (ask.rlike(pattern) & ~asked.rlike(pattern))
    return _list(
        ("adjacent_same_role", letters.rlike("ss|uu|aa")),
        ("missing_tool_evidence", conv.role_letters(source).contains("t") & ~letters.contains("t")),
        ("added_deliverable", added),
        ("vague_completion", final.rlike(X.VAGUE) & ~final.rlike(X.CONCRETE)),
    )
