"""Evaluation texts inside training text.

Every run of ``n`` words of the held-out items goes into one hash set that is broadcast to the
tasks scanning the corpus. A document's words are first mapped to the items' vocabulary; only runs
of at least ``n`` known words are hashed, and each hit is verified word by word. The set is a sorted array of
hashes beside the items' words, some 24 bytes a word; items whose set would be beyond ``most_bytes`` are split into
blocks within it, and the corpus is scanned once a block. The corpus is never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.words import WORD, arrow_map, words

SPANS = "item_id bigint, first_word bigint, last_word bigint"
BYTES_A_WORD, BYTES_A_NAME = 24, 160  # of the index: a word of an item, a different word


class ItemIndex:
    """Windows of ``n`` words of all items; ``spans`` gives a text's verified matches."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.n, self.vocab = n, {}
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        all_ids, owners, starts, at = [], [], [], 0
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int32)
            if len(ids) >= n:
                all_ids.append(ids), starts.append(np.arange(at, at + len(ids) - n + 1, dtype=np.int64))
                owners.append(np.full(len(ids) - n + 1, item, np.int64))
                at += len(ids)
        self.ids = np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        h = self._hash(self.ids)[start] if len(start) else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.starts, self.owners = h[order], start[order].astype(np.int32 if at < 2**31 else np.int64), owner[order]

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        m = len(ids) - self.n + 1
        u = ids.astype(np.uint64)
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out += u[k : k + m] * self.factors[k]
        return out

    def spans(self, found: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, last word), overlapping windows of an item merged."""
        n = self.n
        if len(found) < n or not len(self.hashes):
            return []
        ids = np.fromiter((self.vocab.get(w, 0) for w in found), np.int32, len(found))
        edges = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        hits: dict[int, list[list[int]]] = {}
        for r in np.flatnonzero(np.diff(edges) > n):
            a, b = edges[r] + 1, edges[r + 1]
            h = self._hash(ids[a:b])
            lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            for k in np.flatnonzero(hi > lo):
                window = ids[a + k : a + k + n]
                for e in range(lo[k], hi[k]):
                    if (self.ids[self.starts[e] : self.starts[e] + n] != window).any():
                        continue
                    runs = hits.setdefault(int(self.owners[e]), [])
                    if runs and a + k <= runs[-1][1] + 1:
                        runs[-1][1] = int(a + k + n - 1)
                    else:
                        runs.append([int(a + k), int(a + k + n - 1)])
        return [(item, f, last) for item, runs in sorted(hits.items()) for f, last in runs]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, most_bytes: int = 64 << 20) -> DataFrame:
    """Verified passages: ``doc_id``, item_id, first_word, last_word (0-based word positions of the document).

    Null or empty texts on either side match nothing; items of fewer than ``n`` words match
    nothing. Rows with a null id are left out. Repeated rows give repeated spans. Only the named
    columns are read. Either table may be empty. ``most_bytes``: of the index that is broadcast; beyond it there are
    as many scans as blocks of items.
    """
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tests = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    found = tests.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w"))
    size = found.agg(F.count("*").alias("n"), F.approx_count_distinct("w").alias("d")).first()
    blocks = math.ceil((BYTES_A_WORD * size.n + BYTES_A_NAME * size.d) / most_bytes) or 1
    if blocks > 1:
        blocks *= 2  # blocks by hash are not equally large

    def scan_for(block: int) -> DataFrame:
        some = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r.item_id, r.text) for r in some.toLocalIterator()], n))

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, find = [], index.value.spans
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, *span) for span in find(WORD.findall(t.lower()))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "first_word", "last_word"])

        return corpus.mapInArrow(arrow_map(scan), f"doc_id bigint, {SPANS}")

    out = scan_for(0)
    for block in range(1, blocks):
        out = out.union(scan_for(block))
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Leaking documents only: doc_id, leaked_words, n_words, action, clean_text.

    Spans are cut out of the text (``removed_spans``, the parts around them kept as they stand); a
    document with at least ``drop_share`` of its words in spans is ``dropped`` (clean_text null).
    """
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))  # bounded: spans of one document
    joined = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(by_doc, "doc_id")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, t, runs in zip(*(c.to_pylist() for c in batch.columns)):
            low = t.lower()
            # lower case may change a text's length; positions are then taken from the text itself
            at = [m.span() for m in WORD.finditer(low if len(low) == len(t) else t)]
            inside = np.zeros(len(at) + 1, np.int64)
            for r in runs:
                inside[min(r["first_word"], len(at))] += 1
                inside[min(r["last_word"] + 1, len(at))] -= 1
            mask = np.cumsum(inside)[:-1] > 0
            parts, prev = [], 0
            for k, (a, b) in enumerate(at):
                if mask[k]:
                    if k == 0 or not mask[k - 1]:
                        parts.append(t[prev:a])
                    prev = b
            parts.append(t[prev:])
            gone = bool(len(at)) and mask.sum() >= drop_share * len(at)
            out.append((doc, int(mask.sum()), len(at), "dropped" if gone else "removed_spans", None if gone else "".join(parts)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "leaked_words", "n_words", "action", "clean_text"])

    return joined.mapInArrow(arrow_map(clean), "doc_id bigint, leaked_words bigint, n_words bigint, action string, clean_text string")
