"""Text cut off by field limits or in transfer.

Evidence, all of it gathered over whole tables:

* A value that is a strict prefix of a longer copy elsewhere and stops inside a sentence of it. Values
  are found by the hash of a fixed-length prefix (the largest power of two not over their length; below the
  least of these, their whole length) and verified by the hash of the whole value. A value without a
  letter or digit stands for nothing and begins no sentence.
* A last phrase that elsewhere occurs only as a strict prefix of longer sentences, never (or hardly ever)
  at an end. Phrases of one to three tokens are hashed and counted over all values.
* A value exactly as long as a field limit of its source, where ends without a stop pile up.
* A bracketed or fenced form that was opened and never closed.

Values that end with a stop, a closed form or a shell prompt are complete.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import arrow_rows, cut
from loomline.llm.words import chunks

import xxhash

STOPS = ".!?…。"
_CLOSERS = "\"'`)]}*_»”’"
_BREAK, _STOP = "\x00", "\x01"
COMMON = 5  # times in all texts
BATCH = 1024  # conversations handed to a task at a time
BROADCAST_PREFIXES = 500_000  # 14 MB
PREFIXES = tuple(2**k for k in range(5, 21))  # lengths at which longer copies are looked up; shorter values at their own length
HEAD = 3  # characters by which short suspects are looked up first
_PATH = re.compile(r"^[~.]?(?:/[\w.\-~]*)+$")
_EXT = re.compile(r"\.([a-z][a-z0-9]{0,7})$")
_LABEL = re.compile(r"\W{0,4}[^\W\d][\w() /-]{1,40}:")
_NEW = re.compile(r"\s*(?:[.!?]|\n|$)|\s+[\"'`(]?[A-ZÀ-Þ/]")
_WORDLY = re.compile(r"[^\W_]")
_HEX = re.compile(r"^(?=.*\d)[0-9a-f]+$")


def text_hash(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))


def normal(token: str) -> str:
    """The class of a token that is an id, a path, a number or a composed name; else the word in lower case."""
    t = token.strip("\"'`()[]{}<>*,;:.!?…»«“”")
    if not t:
        return token[:3]
    if "/" in t and _PATH.match(t):
        ext = _EXT.search(t)
        return f"<path.{ext[1]}>" if ext else "<path>"
    if t.isdigit() or re.fullmatch(r"\d+[.,:]\d[\d.,:]*", t):
        return "<number>"
    if _HEX.match(t):
        return f"<hex{len(t)}>"
    if t.startswith("--"):
        return "<option>" if not t.endswith("-") else "<option->"
    if "-" in t:
        first, _, rest = t.partition("-")
        return f"<{first.lower()}-{'#' if rest[-1:].isdigit() else 'a' if rest else ''}>"
    if "_" in t or "::" in t:
        return "<name_>"
    return t.lower()


class _Tokens(dict):
    """token -> hash of its class, the lowest bit telling whether it ends a sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        ends = token in (_BREAK, _STOP) or token.rstrip(_CLOSERS)[-1:] in ("", *STOPS)
        value = self[token] = xxhash.xxh3_64_intdigest(normal(token)) & ~1 | ends
        return value


_tokens = _Tokens()
_ONE = np.uint64(1)
_EDGE, _OVER = (np.uint64(xxhash.xxh3_64_intdigest(x) & ~1) for x in (_BREAK, _STOP))


def _hashed(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    v = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    return v & ~_ONE, (v & _ONE).astype(bool)


def token_hashes(found: list[str]) -> np.ndarray:
    """Hashes of the tokens' classes, with stops told apart."""
    return np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.array([xxhash.xxh3_64_intdigest(f"place {k}") | 1 for k in range(6)], np.uint64)


def phrase_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(key, times at an end, times inside) of all phrases of one to three tokens, and of what follows a token; plain words and their keys.

    A text's own last token counts only if it has a stop: whether it is an end is in question.
    """
    found = f" {_STOP} ".join(t.replace("\n", f" {_BREAK} ") for t in texts).split()
    found.append(_STOP)
    h, final = _hashed(found)
    own = [t for t in set(found) if len(t) > 3 and t.isalpha() and t.islower()]
    del found
    over = h == _OVER
    gap = (h == _EDGE) | over
    real = ~gap
    real[:-1] &= final[:-1] | ~over[1:]
    final[:-1] |= gap[1:]
    real = np.flatnonzero(real)
    ends = final[real].astype(np.float64)
    out: list[tuple[np.ndarray, ...]] = []
    # lengths one after the other: workers keep the most memory they ever took
    for keys in phrase_keys(h, final, gap):
        inverse, uniq = pd.factorize(keys[real])
        n_end = np.bincount(inverse, weights=ends, minlength=len(uniq)).astype(np.int64)
        out.append((uniq, n_end, np.bincount(inverse, minlength=len(uniq)) - n_end))
    return *(np.concatenate(x) for x in zip(*out)), own, _hashed(own)[0]


def phrase_keys(h: np.ndarray, final: np.ndarray, gap: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the one, two and three tokens that end at each place, and of any token after the one before; sentences do not run on."""
    start = final | gap
    one = np.concatenate(([_EDGE], np.where(start[:-1], _EDGE, h[:-1]))) if len(h) else h
    two = np.concatenate(([_EDGE], np.where(start[:-1], _EDGE, one[:-1]))) if len(h) else h
    # tokens are hashes already: odd multiples of them tell phrases of different lengths apart
    yield h
    yield h * _TURNS[0] + one * _TURNS[1]
    yield h * _TURNS[2] + one * _TURNS[3] + two * _TURNS[4]
    yield one * _TURNS[5] + _ODD


def state(text: str | None) -> str:
    """``done``, ``broken`` (a form left open) or ``open`` (no stop at the end); ``empty`` without content."""
    s = text.rstrip() if text else ""
    if not s:
        return "empty"
    if s.count("```") % 2:
        return "broken"
    head = s.lstrip()
    if head[0] == "{" and len(head) > 2 and head[1] in "\"' \n" and not s.endswith("}"):
        return "broken"
    if s.endswith("```") or s.rstrip(_CLOSERS)[-1:] == "$" or (s[-1] in "}]" and s.count("{") == s.count("}") and s.count("[") == s.count("]")):
        return "done"
    if s.rstrip(_CLOSERS)[-1:] in ("", *STOPS):
        return "done"
    return "open"


def style(text: str) -> str:
    """``prose`` if the last line goes on from finished sentences, ``line`` if lines end without stops, ``single`` for one sentence, ``token`` for one or two words."""
    lines = [x for x in text.rstrip().split("\n") if x.strip()]
    if any(t.rstrip(_CLOSERS)[-1:] in tuple(STOPS) and not t[:-1].isdigit() for t in lines[-1].split()[:-1]):
        return "prose"
    if len(lines) > 1 and _LABEL.match(lines[-1]):
        return "line"
    if len(lines) == 1:
        return "single" if len(lines[0].split()) > 2 else "token"
    return "prose" if lines[-2].rstrip().rstrip(_CLOSERS)[-1:] in tuple(STOPS) else "line"


def tails(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text with content: keys of the last token, of the last two, of the last three, of what follows the one before, of the last as the start of a word (0 if it is none), whether it is a path without an extension."""
    lasts = [t.rstrip().rsplit("\n", 1)[-1].split()[-8:] for t in texts]
    ends = np.cumsum([len(x) + 1 for x in lasts], dtype=np.int64) - 1 if lasts else np.empty(0, np.int64)
    h, final = _hashed([t for x in lasts for t in (*x, _BREAK)])
    gap = np.zeros(len(h), bool)
    gap[ends] = True
    uni, bi, tri, after = phrase_keys(h, final, gap)
    words_ = [x[-1].strip("\"'`(*") for x in lasts]
    start = np.array([text_hash("start " + w) if w.isalpha() and w.islower() else 0 for w in words_], np.uint64)
    last = ends - 1
    return uni[last], bi[last], tri[last], after[last], start, np.array(["/" in x[-1] and normal(x[-1]) == "<path>" for x in lasts], bool)


def word_starts(found: set[str]) -> np.ndarray:
    """Hashes of all proper starts of words."""
    starts = {w[:k] for w in found for k in range(1, len(w))}
    return np.fromiter((text_hash("start " + x) for x in starts), np.uint64, len(starts))


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def turns(df: DataFrame, key: str, conversations: str, source: str) -> DataFrame:
    """One pass over conversations: phrase counts and turns that need a look.

    kind 0: lists of equal length: keys with their n_end and n_mid. kind 2: lists words, plain ones, and keys. kind 1: a turn that isn't done: id, turn_index, role, source, length,
    state, key1..key5 (its last phrases and word), path, style, prefix and whole (hashes of its fixed-length
    prefix and of itself), head (how a value shorter than the least of these lengths begins).
    """
    rows = df.where(F.col(key).isNotNull() & F.col(conversations).isNotNull())
    texts = F.transform(F.col(conversations), lambda t: t["content"])
    rows = rows.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), texts.alias("texts"))
    kind_ = rows.schema["id"].dataType.simpleString()
    schema = f"kind int, id {kind_}, turn_index int, source string, length int, state string, key1 bigint, key2 bigint, key3 bigint, key4 bigint, key5 bigint, path boolean, style string, at int, head string, prefix bigint, whole bigint, keys array<bigint>, n_end array<int>, n_mid array<int>, words array<string>"
    names = [f.split()[0] for f in schema.split(", ")]
    own_names = ["kind", "id", "turn_index", "source", "length", "state", "style", "at", "head", "prefix", "whole"]
    lists = {"keys": pa.list_(pa.int64()), "n_end": pa.list_(pa.int32()), "n_mid": pa.list_(pa.int32()), "words": pa.list_(pa.string())}

    def packed(kind: int, types: dict, **columns: np.ndarray) -> pa.RecordBatch:
        """Rows of lists: columns of their own would cost the engine far more."""
        size = len(columns["keys"])
        at = pa.array(np.append(np.arange(0, size, 8192), size).astype(np.int32))
        own = {n: pa.ListArray.from_arrays(at, pa.array(v)) for n, v in columns.items()} | {"kind": pa.array(np.full(len(at) - 1, kind, np.int32))}
        return pa.RecordBatch.from_arrays([own[n] if n in own else pa.nulls(len(at) - 1, types[n]) for n in names], names=names)

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, sources, talks = (part.column(i).to_pylist() for i in range(3))
                out: dict[str, list] = {n: [] for n in own_names}
                flat: list[str] = []
                held: list[str] = []
                for i, src, contents in zip(ids, sources, talks):
                    for k, t in enumerate(contents):
                        if not t or not t.strip():
                            continue
                        flat.append(t)
                        how = state(t)
                        if how == "done":
                            continue
                        held.append(t)
                        at = next((p for p in reversed(PREFIXES) if p <= len(t)), len(t) if _WORDLY.search(t) else 0)
                        values = (1, i, k, src, len(t), how, style(t), at, t[: min(HEAD, at)] if at < PREFIXES[0] else None, text_hash(t[:at]) if at else 0, text_hash(t))
                        for n, v in zip(own_names, values):
                            out[n].append(v)
                m = len(held)
                *keys_, path = tails(held)
                types = {"id": id_type, "source": pa.string(), "state": pa.string(), "style": pa.string(), "head": pa.string(), "kind": pa.int32(), "turn_index": pa.int32(), "length": pa.int32(), "at": pa.int32()}
                cols = {n: pa.array(out[n], types[n]) for n in own_names if n in types}
                cols |= {f"key{k}": pa.array(x.view(np.int64)) for k, x in enumerate(keys_, 1)} | {"path": pa.array(path)}
                cols |= {n: pa.array(_signed(out[n])) for n in ("prefix", "whole")} | {n: pa.nulls(m, t) for n, t in lists.items()}
                if m:
                    yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
                types = {n: c.type for n, c in cols.items()}
                for a, b in chunks(flat):
                    keys, ends, mids, own, own_keys = phrase_counts(flat[a:b])
                    yield packed(0, types, keys=keys.view(np.int64), n_end=ends.astype(np.int32), n_mid=mids.astype(np.int32))
                    yield packed(2, types, keys=own_keys.view(np.int64), words=np.array(own, object))
                del flat, held, talks
                pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def phrase_stats(scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, e, m) times at an end and inside of the phrases whose keys are in the lists of ``wanted``.

    One aggregation counts and selects: a join would sort all phrases, in memory an executor keeps.
    """
    counts = scanned.where("kind = 0").select(F.inline(F.arrays_zip(F.col("keys").alias("k"), F.col("n_end").alias("e"), F.col("n_mid").alias("m"))), F.lit(False).alias("wanted"))
    asked = wanted.select(F.explode("keys").alias("k"), F.lit(0).alias("e"), F.lit(0).alias("m"), F.lit(True).alias("wanted"))
    stats = counts.union(asked).groupBy("k").agg(F.sum("e").alias("e"), F.sum("m").alias("m"), F.max("wanted").alias("wanted"))
    return stats.where("wanted AND e + m > 0").drop("wanted")


def common_starts(scanned: DataFrame, stats: DataFrame) -> DataFrame:
    """(key5) hashes of the starts of words that all texts together hold ``COMMON`` times."""
    common = scanned.where("kind = 2").select(F.inline(F.arrays_zip(F.col("keys").alias("k"), F.col("words").alias("word")))).distinct().join(stats.where(F.col("e") + F.col("m") >= COMMON), "k", "left_semi")

    def starts(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(word_starts(set(batch.column(0).to_pylist())).view(np.int64))], names=["key5"])

    return common.select("word").mapInArrow(starts, "key5 bigint").distinct()


def field_limits(suspects: DataFrame, reach: int = 6, sigmas: float = 6.0, least: int = 6) -> DataFrame:
    """(source, length) at which unfinished values pile up.

    Their number there is beyond the mean of the ``reach`` lengths on either side by ``sigmas`` of its square roots and ``least``.
    """
    counts = cut(suspects.where("source IS NOT NULL AND length > 0").groupBy("source", "length").agg(F.count("*").alias("n")))
    near = counts.select("source", F.explode(F.array(*[F.col("length") + k for k in range(-reach, reach + 1) if k])).alias("length"), F.col("n").alias("m"))
    near = near.groupBy("source", "length").agg((F.sum("m") / (2 * reach)).alias("mean"))
    joined = counts.where(F.col("n") >= least).join(near, ["source", "length"], "left").fillna(0.0, ["mean"])
    return joined.where(F.col("n") >= F.col("mean") + sigmas * F.sqrt("mean") + least).select("source", "length", F.col("n").alias("n_at_limit"))


class Starts:
    """Suspects by the hash of their fixed-length prefix: 28 bytes each."""

    def __init__(self, wanted: pa.Table):
        at, prefix, whole, length = (wanted.column(c).to_numpy() for c in ("at", "prefix", "whole", "length"))
        self.heads: dict[str, list[int]] = {}
        for head, n in {*zip(wanted.column("head").to_pylist(), at.tolist())}:
            if head is not None:
                self.heads.setdefault(head, []).append(n)
        order = np.lexsort((whole, length, prefix))
        self.prefix, self.length, self.whole = prefix[order], length[order], whole[order]
        self.at = [int(x) for x in np.unique(at) if x >= PREFIXES[0]]

    def found(self, texts: list[str]) -> set[int]:
        """Hashes of the suspects that some text goes on after, in the same sentence."""
        owner, h = [], []
        for k, t in enumerate(texts):
            for n in range(1, HEAD + 1):
                for p in self.heads.get(t[:n], ()) if n <= len(t) else ():
                    if p < len(t):
                        owner.append(k), h.append(text_hash(t[:p]))
            for p in self.at:
                if p >= len(t):
                    break
                owner.append(k), h.append(text_hash(t[:p]))
        keys = _signed(h)
        lo, hi = np.searchsorted(self.prefix, keys), np.searchsorted(self.prefix, keys, "right")
        out: set[int] = set()
        for i in np.flatnonzero(hi > lo):
            t, r = texts[owner[i]], slice(lo[i], hi[i])
            for n in np.unique(self.length[r]):  # under twice the prefix
                if n < len(t) and not _NEW.match(t, n):
                    w = _signed([text_hash(t[:n])])[0]
                    same = self.whole[r][self.length[r] == n]
                    if same[min(np.searchsorted(same, w), len(same) - 1)] == w:
                        out.add(int(w))
        return out


def longer_copies(suspects: DataFrame, df: DataFrame, key: str, conversations: str) -> DataFrame:
    """(whole) hashes of suspects that are strict prefixes of a longer value and stop inside a sentence of it.

    While there are at most ``BROADCAST_PREFIXES`` of them (28 bytes each) they are held against the values where these lie. Else
    hashes of prefixes are joined first, and only values that begin like a suspect are moved.
    """
    wanted = cut(suspects.where("at > 0").select("at", "head", "prefix", "whole", "length").distinct())
    spark, few = df.sparkSession, wanted.count() <= BROADCAST_PREFIXES
    texts = F.transform(F.col(conversations), lambda t: t["content"])
    rows = df.where(F.col(conversations).isNotNull()).select(F.col(key).alias("id"), texts.alias("texts"))

    def slices(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part, [[t for t in x if t] for x in part.column("texts").to_pylist()]

    if few:
        starts = spark.sparkContext.broadcast(Starts(wanted.toArrow()))

        def check(batches):
            for _, lists in slices(batches):
                out = starts.value.found([t for x in lists for t in x])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], names=["whole"])

        return rows.select("texts").mapInArrow(check, "whole bigint").distinct()

    lengths = sorted({*PREFIXES, *(r["at"] for r in wanted.where(F.col("at") < PREFIXES[0]).select("at").distinct().collect())})  # one row per length under 32

    def prefixes(with_text: bool):
        def run(batches):
            for part, lists in slices(batches):
                owner, at, h, text = [], [], [], []
                for k, x in enumerate(lists):
                    for t in x:
                        for p in lengths:
                            if p >= len(t):
                                break
                            owner.append(k), at.append(p), h.append(text_hash(t[:p])), text.append(t)
                first = pa.array(text, pa.string()) if with_text else part.column("id").take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([first, pa.array(at, pa.int32()), pa.array(_signed(h))], names=["value" if with_text else "id", "at", "prefix"])

        return run

    kind = rows.schema["id"].dataType.simpleString()
    alike = rows.where("id IS NOT NULL").mapInArrow(prefixes(False), f"id {kind}, at int, prefix bigint").join(wanted.select("at", "prefix").distinct(), ["at", "prefix"], "left_semi").select("id").distinct()
    values = rows.join(alike, "id", "left_semi").mapInArrow(prefixes(True), "value string, at int, prefix bigint").distinct()
    hit = values.join(wanted, ["at", "prefix"]).where(F.length("value") > F.col("length")).select("whole", "length", "value")

    def verify(batches):
        for batch in batches:
            # what follows must go on with the sentence: not a stop, a new line or a new sentence
            ok = [w for w, n, v in zip(*(c.to_pylist() for c in batch.columns)) if not _NEW.match(v, n) and text_hash(v[:n]) == w & (2**64 - 1)]
            if ok:
                yield pa.RecordBatch.from_arrays([pa.array(ok, pa.int64())], names=["whole"])

    return hit.mapInArrow(verify, "whole bigint").distinct()


# Below these chances that a phrase is an end, a text that stops there was cut; with finished sentences before it, the missing stop counts too.
# A last token that is hardly seen anywhere is a word cut short, unless the token before it often comes last but one.
LIKELY = {"prose": 0.095, "single": 0.05, "line": 0.004}
# Still more so if common words begin with it. A path without an extension was cut unless such paths are usual there.
RARE, LIKELY_RARE = 10, {"prose": 0.25, "single": 0.25, "line": 0.04}
LIKELY_START, LIKELY_PATH = {"prose": 0.9, "single": 0.9, "line": 0.15}, {"prose": 0.6, "single": 0.6, "line": 0.3}
_WEIGHT, LOOKS_CUT = 20.0, 0.15


def truncated_turns(df: DataFrame, key: str, conversations: str, source: str, probes: DataFrame | None = None) -> DataFrame:
    """Turns without a proper end: id, turn_index, source, length, style, chance, reason; reason is null if it wasn't cut.

    reason: ``form``, ``limit``, ``longer_copy`` or ``phrase``. chance: how often the last phrase is an end elsewhere,
    from three tokens backed by two, one and the token before. Turns are numbered from 0. Null and
    blank contents are not cut; null keys and conversations are left out; repeated rows count once in the
    result. A null source shares the limits of all sources. An empty table gives no rows. ``probes`` (same columns,
    ids of their own) are judged by the form and last phrases of their turns too, but counted nowhere: neither as phrases nor for limits or copies.
    """
    with arrow_rows(df.sparkSession, BATCH):
        return _truncated(df, key, conversations, source, probes)


def _truncated(df: DataFrame, key: str, conversations: str, source: str, probes: DataFrame | None) -> DataFrame:
    scanned = cut(turns(df, key, conversations, source))
    suspects = scanned.where("kind = 1").drop("kind", "keys", "n_end", "n_mid", "words").distinct()
    if probes is not None:
        more = cut(turns(probes, key, conversations, source).where("kind = 1").drop("kind", "keys", "n_end", "n_mid", "words"))
        suspects = suspects.unionByName(more.withColumns({"length": F.lit(-1), "at": F.lit(0), "whole": F.lit(None).cast("bigint")}))
    keys = F.array("key1", "key2", "key3", "key4").alias("keys")
    wanted = scanned.where("kind = 1").select(keys) if probes is None else scanned.where("kind = 1").select(keys).union(more.select(keys))
    stats = cut(phrase_stats(scanned, wanted.union(scanned.where("kind = 2").select("keys"))))
    copies = longer_copies(suspects, df, key, conversations).withColumn("longer", F.lit(True))
    rows = suspects.join(copies, "whole", "left")
    for i in (1, 2, 3, 4):
        rows = rows.join(stats.select(F.col("k").alias(f"key{i}"), F.col("e").alias(f"e{i}"), (F.col("e") + F.col("m")).alias(f"n{i}")), f"key{i}", "left")
        rows = rows.fillna(0, [f"e{i}", f"n{i}"])
    p = F.lit(0.05)
    for i in (4, 1, 2, 3):  # each is backed by the one before
        p = (F.col(f"e{i}") + _WEIGHT * p) / (F.col(f"n{i}") + _WEIGHT)
    # without a plain word the key is one of the row's own that matches nothing: a shared one would be a hot key
    rows = rows.withColumns({"chance": p, "worded": F.col("key5") != 0}).withColumn("key5", F.when(F.col("worded"), F.col("key5")).otherwise(F.xxhash64("id", "turn_index", "key3")))
    starts = common_starts(scanned, stats).join(suspects.where("key5 != 0").select("key5").distinct(), "key5", "left_semi")
    rows = rows.join(starts.withColumn("start", F.lit(True)), "key5", "left")
    rows = cut(rows.select("id", "turn_index", "source", "length", "state", "style", "path", "worded", "n1", "chance", F.coalesce(F.col("start") & F.col("worded"), F.lit(False)).alias("start"), "longer"))
    # limits show in values that look cut; at a limit, all without a stop were
    limits = cut(field_limits(rows.where(F.col("chance") < LOOKS_CUT)))
    rows = rows.join(limits.select("source", "length", F.lit(True).alias("limit")), ["source", "length"], "left")
    rows = rows.join(limits.select("length", F.lit(True).alias("some_limit")).distinct(), "length", "left")
    limit = F.coalesce("limit", F.col("source").isNull() & F.col("some_limit"), F.lit(False))
    likely = F.lit(0.0)
    for name in LIKELY:
        rare = F.when((F.col("n1") < RARE) & F.col("start"), LIKELY_START[name]).when(F.col("path"), LIKELY_PATH[name])
        rare = rare.when((F.col("n1") < RARE) & (F.lit(name != "line") | F.col("worded")), LIKELY_RARE[name])
        likely = F.when(F.col("style") == name, rare.otherwise(LIKELY[name])).otherwise(likely)
    reason = F.when(F.col("state") == "broken", "form").when(limit, "limit").when(F.col("longer"), "longer_copy").when(F.col("chance") < likely, "phrase")
    return rows.select("id", "turn_index", "source", "length", "state", "style", "chance", reason.alias("reason"))
