"""Column expressions over strings that agree with Python's Unicode rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that Python calls white space; Java's \s leaves most of them out.
WS = r"(?U)[\s\x1c-\x1f]"

# Token shapes and words that carry no task.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.+/#:@~-]*"
URL = r"(?i)https?://[^\s`\"'<>]+"
PATH = r"(?U)(?<!\w)(?:~?/|\./|\.\./)[^\s`\"'<>(),;]+"
BACKTICK = r"`([^`\n]+)`"
QUOTED = r"(?<![A-Za-z])[\"']([^\"'\n]{2,120})[\"']"
FLAG = r"(?U)(?<!\w)--[A-Za-z0-9][A-Za-z0-9-]*"
NUMBER = r"(?U)(?<!\w)\d+(?:\.\d+)*(?!\w)"
# Patterns of the policy and of errors that pass, and forms of deliverables.
REFUSAL = (
    r"(?i)\b(?:i(?:['’]m| am) sorry|i apologize|i (?:cannot|can't|won't|am unable to) (?:help|assist|comply|fulfill)|"
    r"(?:cannot|can't|unable to) (?:complete|continue|proceed|perform|fulfill)|request cannot be fulfilled|as an ai|something went wrong|no solution)\b"
)
DEGENERATE = r"(?i)i (don't|do not) have access to (a|an) (real|actual) (environment|terminal|shell)|as an ai( language model)?,? i (cannot|can't|am unable)|i'm unable to actually execute"
VAGUE = r"(?i)\b(?:inspection|review|task|work|implementation) (?:is|was|has been) (?:complete|completed)\b|\b(?:identified|reviewed) (?:the )?(?:main|key|necessary)\b"
CONCRETE = r"(?i)`[^`]+`|https?://|(?:^|\s)(?:\.?\.?/|~/)[^\s]+|--[A-Za-z0-9-]+|\b[A-Za-z0-9_-]+\.[A-Za-z0-9]{1,8}\b|\d"
TRANSIENT = r"(?i)429|500|503|rate_limit|too many|throttling"
STOP_WORDS = (
    "and", "are", "but", "can", "could", "does", "for", "from", "have", "how", "into", "its", "may", "not", "please", "should", "that",
    "the", "their", "then", "this", "use", "using", "want", "when", "where", "which", "will", "with", "would", "you", "your",
)
DELIVERABLES = {
    "summary": ("summary", "summarize", "summarise"),
    "report": ("report",),
    "explanation": ("explain", "explanation"),
    "recommendation": ("recommend", "recommendation"),
    "comparison": ("compare", "comparison"),
    "documentation": ("document", "documentation"),
}


def strip(c: Column) -> Column:
    """Python's ``str.strip``: Spark's ``trim`` takes blanks only."""
    return F.regexp_replace(c, rf"^{WS}+|(?U)[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def casefold(c: Column) -> Column:
    """Text under which strings that differ in case only are equal, by Python's ``str.casefold``: sharp s is ss, all sigmas are one."""
    # upper case joins the variants of a letter; the dotless i, which it would turn into an i, is set aside
    # (put back between the two, which also keeps the optimizer from dropping the inner one)
    apart = F.replace(F.replace(c, F.lit("ı"), F.lit("\ue0f1")), F.lit("ẞ"), F.lit("ss"))
    folded = F.replace(F.lower(F.replace(F.upper(apart), F.lit("\ue0f1"), F.lit("ı"))), F.lit("ς"), F.lit("σ"))
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(c))


def content_key(c: Column) -> Column:
    """The key under which contents count as the same: case and white space do not matter."""
    return squeeze(casefold(c))


def json_escape(c: Column) -> Column:
    """The inside of a JSON string, without escaping beyond what JSON asks for (control characters in lower-case hex)."""
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    rest = c
    for k in (*range(0, 8), 11, *range(14, 32)):
        rest = F.replace(rest, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.when(c.rlike(r"[\x00-\x1f]"), rest).otherwise(c)


def tokens(text: Column) -> Column:
    """Distinct task tokens: lower case, at least three characters, no stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(F.lower(t), F.lit(".,:;")))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) >= 3), stop)


def token_sequence(text: Column) -> Column:
    """Task tokens of at least two characters in order, repeats and stop words included."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(F.lower(t), F.lit(".,:;")))
    return F.filter(found, lambda t: F.length(t) >= 2)


def anchors(text: Column) -> Column:
    """Distinct exact values of a task: URLs, paths, flags, numbers, quoted values and tokens with a sign, digit or inner capital."""
    plain = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda a: F.rtrim(F.lower(a), F.lit(".,:;"))) for p in (URL, PATH, FLAG, NUMBER)]
    quoted = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda a: F.rtrim(content_key(a), F.lit(".,:;"))) for p in (BACKTICK, QUOTED)]
    raw = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit(".,:;")))
    odd = F.filter(raw, lambda t: t.rlike(r"[_./:@+\-]|\d") | (F.substring(t, 2, 1 << 30).rlike("[A-Z]") & (F.length(t) >= 4)))
    quoted_ok = F.filter(F.flatten(F.array(*quoted)), lambda a: F.length(a).between(2, 120))
    return F.array_remove(F.array_distinct(F.concat(*plain, quoted_ok, F.transform(odd, F.lower))), "")


def share_kept(source: Column, other: Column) -> Column:
    """Share of the source's distinct values the other has; 1 if the source has none."""
    return F.when(F.size(source) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(source, other)) / F.size(source))
