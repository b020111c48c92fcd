"""Template residue, filler, error pages and script notices.

Labels come from a library of trusted sentences (``seeds``) and spread to the sentences of the corpus by near-duplicate search:

1. Texts are split into sentences; numbers, ids and paths are masked. A sentence, or what is left of it behind words it was
   glued to, is linked to a trusted sentence if at least ``ALIKE`` of the words of the longer one are common to both. No such pair
   is missed (``Index``).
2. The sentences of all texts are compared in the same way with those linked to residue, then with those found so, until none is new.
3. All sentences of texts with any of these are put into partitioned SimHash tables (256 bits over the words), candidates within
   ``RADIUS`` are verified by their words, and the labels spread through the connected components of all links.
4. A text is residue if sentences of one kind outweigh what is neither residue nor page furniture.

Slots that were never filled in and mock Latin have no fixed sentences: they are recognised by their form and their vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import cut
from loomline.llm.components import components
from loomline.llm.neardup import candidate_pairs
from loomline.llm.seeds import SEEDS
from loomline.llm.words import arrow_map, mix

KINDS = ("placeholder", "filler", "error_page", "script_notice")
ALIKE = 0.7  # least share of common words
PRINTS, BITS = 4, 256
RADIUS = 88  # measured on sentences of 3 to 13 words: a share of 0.7 differs in 59 of 256 bits, at most in 84; 99 % of unrelated ones in 100 or more
FRONTIER = 100_000  # sentences that are broadcast at once to be compared with all texts; beyond it there are more scans
TABLES, TABLE_BITS = 32, 12  # windows of 12 bits, one at every byte; at 47 differing bits some window agrees with 96 %

# Sentences that quote or explain slots; what they quote is no residue.
_QUOTES = (
    re.compile(r"unfilled slots such as[^.]*", re.I),
    re.compile(r"the prompt template uses one variable[^:]*:?", re.I),
    re.compile(r"summarize \{\{ ?task ?\}\} for \$\{user\}", re.I),
    re.compile(r"\b(?:vorlage|modèle|plantilla|template|gabarit)\W{0,3}(?:\{\{|\$\{|\{|<|\[)[^.\n]{1,40}?(?:\}|>|\])`?\s*(?:wird|est|se|is|are|ist)\b", re.I),
    re.compile(r"\bsets `?\w+: \{\{ ?\.\w[\w.]* ?\}\}`?", re.I),
)
_QUOTE_SIGNS = ("unfilled slots", "prompt template", "summarize {{", "vorlage", "modèle", "plantilla", "template", "gabarit", "sets `", "sets name:")
# Slots as template languages and forms write them: (a sign that is quick to find, the pattern)
_SLOTS = tuple(
    (sign, re.compile(pattern))
    for sign, pattern in (
        ("{{", r"\{\{\s*(?!\.)[^\W\d][\w ]{0,40}\s*\}\}"),
        ("${", r"\$\{[^\W\d]\w{0,40}\}"),
        ("<%", r"<%=?\s*[^\W\d][\w ]{0,40}%>"),
        ("<<", r"<<[^\W\d][\w ]{0,40}>>"),
        ("<", r"<(?!NOSCRIPT)[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ_ ]{2,40}>"),
        ("[", r"\[[A-ZÀ-ÖØ-Þ][\w ]{1,40}\](?!\()"),
        ("[", r"\[(?i:insert|add a short|remplacer par|completar|bitte|your|hier|à compléter)\b[^\]\n]{1,60}\]"),
        ("%(", r"%\([^\W\d]\w{0,40}\)s"),
        ("@@", r"@@[^\W\d]\w{1,40}@@"),
        ("__", r"__[^\W\d_]\w{0,40}?__"),
        ("{", r"(?<![\w$%{])\{[^\W\d]\w{2,40}\}(?!\})"),
        ("XXXX", r"\bX{4}\b"),
        ("#", r"(?<!\w)#[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ_]{2,40}#(?!\w)"),
        ("~~", r"~~[^\W\d]\w{1,40}~~"),
        ("______", r"(?<!\w)_{6,}(?!\w)"),
        ("(", r"\((?i:your|votre|ihr|su) [\w ]{2,30} (?i:goes here|ici|hier|aquí)\)"),
    )
)
# Writing instructions that were never followed (lower case).
_ORDERS = tuple(
    (sign, re.compile(pattern))
    for sign, pattern in (
        ("todo:", r"todo: (?:describe|add|write|fill)\b"),
        ("replace this paragraph", r"replace this paragraph with"),
        ("here before", r"insert [\w ]{2,30} here before"),
        ("fill in the", r"fill in the [\w ]{2,30}\.(?=\s|$)"),
        ("à compléter", r"à compléter ?:"),
        ("insérer ici", r"insérer ici ?:"),
        ("insertar aquí", r"insertar aquí ?:"),
        ("pendiente de rellenar", r"pendiente de rellenar ?:"),
        ("noch auszufüllen", r"noch auszufüllen ?:"),
        (" einfügen", r"\bhier [\w ]{2,30} einfügen\b"),
    )
)
# Words of mock Latin.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum curabitur curabi donec eget erit fermentum fermen "
    "labor lacus mauris ornare ornis pellentesque pellen porta risus rutrum rutum sedis ulla vella vero".split()
)


def has_slots(text: str, low: str) -> bool:
    """Whether slots or writing instructions are left that no sentence merely quotes."""
    for sign, pattern in _ORDERS:
        if sign in low and pattern.search(low):
            return True
    if not any(sign in text and pattern.search(text) for sign, pattern in _SLOTS):
        return False
    if any(sign in low for sign in _QUOTE_SIGNS):
        for quote in _QUOTES:
            text = quote.sub(" ", text)
        return any(sign in text and pattern.search(text) for sign, pattern in _SLOTS)
    return True


# Words, paths, and what ends a sentence.
_TOKEN = re.compile(r"[~.]?(?:/[\w.\-]+)+|[^\W_]+|[.!?…]+(?=[\s\"'<)]|$)|[\n\"|{}<>;•]|:(?=\s|$)|\\n|\s[-–—]\s")
_JS = re.compile(r"\b(?:java script|ecma ?script|(?:browser|client-side) scripting|scripting|js)\b")
_TAGS = frozenset("html head body div span center hr br noscript title href class".split())
_BREAK, _MASK = 0, 1  # hashes of ends and of numbers, ids, paths and tags


class _Tokens(dict):
    def __missing__(self, t: str) -> int:
        if len(self) > 150_000:
            self.clear()
        if "/" in t or t in _TAGS or any(c.isdigit() for c in t):
            value = _MASK
        else:
            value = xxhash.xxh3_64_intdigest(t) | 2 if t[0].isalnum() else _BREAK
        self[t] = value
        return value


class _Raw(dict):
    """Hashes of tokens as they stand; 0 for those that are no words."""

    def __missing__(self, t: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) | 1 if t[-1].isalnum() else 0
        return value


_tokens, _raw = _Tokens(), _Raw()


def tokens(low: str) -> list[str]:
    """Words, paths and ends of a lower-case text; the names of browser scripting are one."""
    return _TOKEN.findall(_JS.sub("javascript", low) if "script" in low or "js" in low else low)


_TIES = np.random.default_rng(6).integers(0, 2, BITS, dtype=np.int16) * 2 - 1  # ties of a bit fall alike in all sentences


def prints(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHashes of the runs of word hashes that begin at ``starts``, as rows of 64-bit words."""
    if not len(starts):
        return np.empty((0, PRINTS), np.uint64)
    some, at = np.unique(words, return_inverse=True)
    wide = np.stack([mix(some + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, PRINTS + 1)], axis=1)
    signs = np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int16) * 4 - 2
    out = np.empty((len(starts), BITS // 8), np.uint8)
    ends = np.append(starts[1:], len(words))
    for lo in range(0, len(starts), 4096):
        hi = min(lo + 4096, len(starts))
        part = signs[at[starts[lo] : ends[hi - 1]]]
        out[lo:hi] = np.packbits(np.add.reduceat(part, starts[lo:hi] - starts[lo], axis=0) + _TIES > 0, axis=1)
    return out.view(np.uint64)


def alike(a: Counter, b: Counter) -> float:
    """Words in common, as a share of the longer sentence."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return sum(min(k, large[w]) for w, k in small.items()) / max(a.total(), b.total())


def _take(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs of ``sizes`` from ``starts``, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


def _fingerprints(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of word hashes, in order."""
    at = _take(starts, sizes)
    order = mix(np.arange(1, int(sizes.max(initial=0)) + 1, dtype=np.uint64))
    return np.add.reduceat(mix(words[at] + order[at - np.repeat(starts, sizes)]), np.cumsum(sizes) - sizes)


class Index:
    """Sentences by their words: all of them that are at least ``ALIKE`` to others, none left out.

    Of n words at most n - ALIKE n are not common to both, so one of the n - ALIKE n + 1 rarest is.
    """

    PAIRS = 1_000_000  # that are compared at once

    def __init__(self, each: list[np.ndarray], groups: np.ndarray | None = None):
        self.groups = np.arange(len(each)) if groups is None else groups
        self.sizes = np.array([len(x) for x in each], np.int64)
        flat, of = np.concatenate(each), np.repeat(np.arange(len(each)), self.sizes)
        self.vocabulary, word = np.unique(flat, return_inverse=True)
        self.shortest, self.longest = ALIKE * int(self.sizes.min()), int(self.sizes.max() / ALIKE)
        order = np.lexsort((word, of))
        word, of = word[order], of[order]
        nth = _nth(word, of)
        self.most = int(nth.max()) + 1  # times a word is in one sentence
        self.keys = of * (len(self.vocabulary) * self.most) + word * self.most + nth  # ascending
        once = nth == 0
        by_word = np.lexsort((of[once], self.groups[of[once]], word[once]))
        self.owners = of[once][by_word]
        self.many = int(self.groups.max()) + 1
        self.by_group = word[once][by_word] * self.many + self.groups[self.owners]  # ascending
        self.counts = np.bincount(word, weights=once, minlength=len(self.vocabulary)).astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts

    def likely(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs with enough words that occur in any own sentence; those words, and which of them do."""
        rows = np.flatnonzero((sizes >= self.shortest) & (sizes <= self.longest))
        if not len(rows):
            return rows, rows, rows
        n = sizes[rows]
        flat = words[_take(starts[rows], n)]
        word = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == flat
        ok = np.add.reduceat(known, np.cumsum(n) - n, dtype=np.int64) >= ALIKE * n
        keep = np.repeat(ok, n)
        return rows[ok], word[keep], known[keep]

    def pairs(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, own sentence, likeness) of all pairs that are alike, in ascending order; runs of ``words`` have at least one. ``but``: a group not to compare with, -1 for none."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, word, known = self.likely(words, starts, sizes)
        if not len(rows):
            return none
        n = sizes[rows]
        first, of = np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n)
        word = np.where(known, word, -1)
        seen = np.where(known, self.counts[word], 0)
        order = np.lexsort((word, seen, of))  # the rarest words of a run come first
        word, seen = word[order], seen[order]
        nth = _nth(word, of)
        feature = np.where((word >= 0) & (nth < self.most), word * self.most + nth, -1)
        need = np.ceil(ALIKE * n - 1e-9).astype(np.int64)
        look = (np.arange(len(word)) - first[of] <= (n - need)[of]) & (word >= 0) & (nth == 0)
        at = np.flatnonzero(look)
        run, begin, end = of[at], self.begins[word[at]], self.begins[word[at]] + seen[at]
        if but is not None:  # what stands before and behind that group
            own = but[rows][run]
            key = word[at] * self.many + own
            skip = (own >= 0) & (own < self.many)
            low, high = (np.where(skip, np.searchsorted(self.by_group, key, side), end) for side in ("left", "right"))
            run, begin, end = np.stack([run, run], 1).ravel(), np.stack([begin, high], 1).ravel(), np.stack([low, end], 1).ravel()
        seen = end - begin
        total = np.concatenate(([0], np.cumsum(np.bincount(run, weights=seen, minlength=len(rows)).astype(np.int64))))
        out, lo = [], 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + self.PAIRS, "right")) - 1)
            a, b = np.searchsorted(run, (lo, hi))
            r, k = np.repeat(run[a:b], seen[a:b]), self.owners[_take(begin[a:b], seen[a:b])]
            fits = np.minimum(n[r], self.sizes[k]) >= ALIKE * np.maximum(n[r], self.sizes[k])
            both = np.unique(r[fits] * len(self.sizes) + k[fits])
            r, k = both // len(self.sizes), both % len(self.sizes)
            if len(r):
                own = feature[_take(first[r], n[r])]
                key = np.repeat(k, n[r]) * (len(self.vocabulary) * self.most) + own
                hit = (own >= 0) & (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)
                share = np.add.reduceat(hit, np.cumsum(n[r]) - n[r], dtype=np.int64) / np.maximum(n[r], self.sizes[k])
                ok = share >= ALIKE
                out.append((rows[r[ok]], k[ok], share[ok]))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _nth(word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often a word came before in its run, where equal words of a run stand side by side."""
    new = np.concatenate(([True], (np.diff(word) != 0) | (np.diff(of) != 0)))
    return np.arange(len(word)) - np.flatnonzero(new)[np.cumsum(new) - 1]


class Seeds(Index):
    """The trusted sentences; a bounded set."""

    def __init__(self, seeds: list[tuple[str, str]]):
        self.labels = [kind for kind, _ in seeds]
        each = [np.array([_tokens[t] for t in tokens(x)], np.uint64) for _, x in seeds]
        super().__init__(each)
        self.latin = np.array(sorted(_tokens[w] for w in _LATIN), np.uint64)

    def nearest(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence the closest seed (-1: none) and their likeness."""
        best, share = np.full(len(starts), -1), np.zeros(len(starts))
        i, k, s = self.pairs(words, starts, sizes)
        order = np.lexsort((k, -s, i))
        i, k, s = i[order], k[order], s[order]
        one = np.concatenate(([True], np.diff(i) > 0))[: len(i)]
        best[i[one]], share[i[one]] = k[one], s[one]
        return best, share


def _sentences(texts: list[str | None], seeds: Seeds, every: bool = False) -> list[tuple]:
    """(text number, rank, words, words of Latin, seed, likeness, hash, sentence, slots, null, null, null) of all sentences of texts that have a seed that is no furniture, or Latin
    (``every``: of all texts); (.., hash of all words, hashes of the words of its sentences, their sizes) of each text.
    """
    found = [tokens(t.lower()) if t else [] for t in texts]
    flat = list(chain.from_iterable(found))
    h = np.fromiter(map(_tokens.__getitem__, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    real = np.flatnonzero(h != _BREAK)
    w, of = h[real], doc[real]
    if not len(w):
        return []
    st = np.flatnonzero(np.concatenate(([True], (np.diff(real) > 1) | (np.diff(of) > 0))))
    en = np.append(st[1:], len(w))
    known, latin, masked = (np.concatenate(([0], np.cumsum(x))) for x in (np.isin(w, seeds.vocabulary), np.isin(w, seeds.latin), w == _MASK))

    def match(st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per run of words the seed its end is like (-1: none), their likeness, and where that end begins."""
        seg, at = [], []
        for n in range(1, seeds.longest + 1):  # the whole, and whatever ends it
            ok = np.flatnonzero(en - st >= n)
            a = en[ok] - n
            fits = ((known[a + 1] > known[a]) & (n > 1)) | (a == st[ok])
            fits &= known[en[ok]] - known[a] >= ALIKE * n
            seg.append(ok[fits]), at.append(a[fits])
        seg, at = np.concatenate(seg), np.concatenate(at)
        seed, likeness, begin = np.full(len(st), -1), np.zeros(len(st)), st.copy()
        if not len(at):
            return seed, likeness, begin
        sizes = en[seg] - at
        # equal runs are looked up once
        _, first, back = np.unique(_fingerprints(w, at, sizes), return_index=True, return_inverse=True)
        best, share = seeds.nearest(w, at[first], sizes[first])
        best, share = best[back], share[back]
        for i in np.flatnonzero(best >= 0):  # the most alike, then the longest
            if share[i] >= likeness[seg[i]]:
                seed[seg[i]], likeness[seg[i]], begin[seg[i]] = best[i], share[i], at[i]
        return seed, likeness, begin

    seed, likeness, begin = match(st, en)
    # what stands before a matched end may hold further ones
    parts = {int(s): [(int(begin[s]), int(en[s]), int(seed[s]), float(likeness[s]))] for s in np.flatnonzero(seed >= 0)}
    rest = np.flatnonzero((seed >= 0) & (begin > st))
    left = begin.copy()
    while len(rest):
        more, how, where = match(st[rest], left[rest])
        for s, k, x, a in zip(rest.tolist(), more.tolist(), how.tolist(), where.tolist()):
            if k >= 0:
                parts[s].append((a, int(left[s]), k, x))
                left[s] = a
        rest = rest[(more >= 0) & (left[rest] > st[rest])]
    pure = (en - st >= 4) & (latin[en] - latin[st] >= 0.8 * (en - st))
    rules = np.array([bool(t) and has_slots(t, t.lower()) for t in texts])
    wanted = np.zeros(len(texts), bool)  # slots need no sentences
    wanted[of[st[pure]]] = True
    wanted[of[st[[s for s, runs in parts.items() if any(seeds.labels[k] != "furniture" for _, _, k, _ in runs)]]]] = True
    seeded = {a: (k, x) for runs in parts.values() for a, _, k, x in runs}
    begins = np.union1d(st, np.array(list(seeded), np.int64))  # of sentences, glued ones too
    sizes = np.diff(np.append(begins, len(w)))
    segment = np.searchsorted(st, begins, "right") - 1
    n = sizes - (masked[begins + sizes] - masked[begins])
    n_latin = np.where(pure[segment], latin[begins + sizes] - latin[begins], 0)
    prints_ = _fingerprints(w, begins, sizes).view(np.int64)
    out, rank, last, own = [], 0, -1, -1
    for i in np.flatnonzero(wanted[of[begins]] | every).tolist():
        a, s = int(begins[i]), int(segment[i])
        if of[a] != last:
            rank, last = 0, int(of[a])
        elif s != own and (rank or flat[real[st[s]] - 1] != ":"):  # what follows the colon of a heading belongs to it
            rank += 1
        own, b = s, a + int(sizes[i])
        name = " ".join("0" if v == _MASK else flat[j] for v, j in zip(w[a:b].tolist(), real[a:b].tolist()))
        out.append((last, rank, int(n[i]), int(n_latin[i]), *seeded.get(a, (-1, 0.0)), int(prints_[i]), name, bool(rules[last])))
    # what may be linked
    some = np.flatnonzero((n > 0) & (n_latin == 0))
    text_of = of[begins[some]]
    linked_words, linked_sizes = w[_take(begins[some], sizes[some])], sizes[some].astype(np.int32)
    ends = np.searchsorted(text_of, np.arange(len(texts)), "right")
    word_ends = np.concatenate(([0], np.cumsum(sizes[some])))[ends]
    # a row of its own for every text with words: what tells copies
    raw = np.fromiter(map(_raw.__getitem__, flat), np.uint64, len(flat))
    at = np.flatnonzero(raw)
    if not len(at):
        return [(*x, None, None, None) for x in out]
    of = doc[at]
    begin = np.flatnonzero(np.concatenate(([True], np.diff(of) > 0)))
    rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    same = np.add.reduceat(mix(raw[at] + mix(rank.astype(np.uint64) + np.uint64(1))), begin).view(np.int64)
    each = []
    for d, c in zip(of[begin].tolist(), same.tolist()):
        lo, first = (int(ends[d - 1]), int(word_ends[d - 1])) if d else (0, 0)
        each.append((d, -1, 0, 0, -1, 0.0, 0, "", bool(rules[d]), c, linked_words[first : word_ends[d]].tobytes(), linked_sizes[lo : ends[d]].tobytes()))
    return [(*x, None, None, None) for x in out] + each


_COLUMNS = (
    ("rank", "int", pa.int32()), ("n", "int", pa.int32()), ("latin", "int", pa.int32()), ("seed", "int", pa.int32()), ("likeness", "double", pa.float64()), ("sentence", "bigint", pa.int64()), ("words", "string", pa.string()), ("slots", "boolean", pa.bool_()), ("copy", "bigint", pa.int64()),
    ("hashes", "binary", pa.binary()), ("sizes", "binary", pa.binary()),
)


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The hashes of the words of sentences."""
    each = [np.array([_tokens[t] for t in x.split()], np.uint64).tobytes() for x in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary()), batch.column(2)], names=["sentence", "hashes", "seed"])


def _spread(texts: DataFrame, first: DataFrame, seeds, most: int) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) of trusted residue to others of any text, by way of sentences between them, and the texts (id, mark) these are in; null if there are none.

    ``texts``: id, mark, hashes and sizes of the sentences of each. ``first``: sentence, hashes (of its words), seed. What is found is looked for in turn, with the
    seed it goes back to, until nothing is new. Sentences of one seed are in one component anyway and not compared; those that are like trusted furniture
    pass nothing on, as chains of "line 3 in fetch" and the like lead to any sentence. ``most`` sentences are broadcast at once;
    beyond it there are as many scans as blocks.
    """
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    fields = f"id {kind}, mark bigint, a bigint, b bigint, hashes binary"

    def compare(block: DataFrame) -> DataFrame:
        rows = [(np.frombuffer(x.hashes, np.uint64), x.seed) for x in block.select("hashes", "seed").toLocalIterator()]
        index = spark.sparkContext.broadcast(Index([x for x, _ in rows], np.array([x for _, x in rows], np.int64)))

        def probe(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            known = index.value
            w = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            each = batch.column(3).to_pylist()
            sizes = np.frombuffer(b"".join(each), np.int32).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            runs = known.likely(w, starts, sizes)[0] if len(sizes) else sizes
            if not len(runs):
                return None
            # equal sentences are compared once
            names, one, back = np.unique(_fingerprints(w, starts[runs], sizes[runs]).view(np.int64), return_index=True, return_inverse=True)
            starts, sizes = starts[runs[one]], sizes[runs[one]]
            own = seeds.value.nearest(w, starts, sizes)[0]
            i, k, _ = known.pairs(w, starts, sizes, own)
            passed = ~np.isin(own[i], np.flatnonzero(np.array(seeds.value.labels) == "furniture"))
            if not passed.any():
                return None
            i, seed = np.unique(np.stack([i[passed], known.groups[k[passed]]]), axis=1)
            of = np.repeat(np.arange(len(each)), [len(x) // 4 for x in each])
            found = np.unique(of[runs[np.isin(back, i)]])
            n, m, ids = len(found), len(i), batch.column(0).take(pa.array(found))
            hashes = [None] * n + [w[a : a + z].tobytes() for a, z in zip(starts[i].tolist(), sizes[i].tolist())]
            columns = ((ids, pa.nulls(m, ids.type)), (batch.column(1).take(pa.array(found)), pa.nulls(m, pa.int64())), (pa.nulls(n, pa.int64()), pa.array(seed)), (pa.nulls(n, pa.int64()), pa.array(names[i])))
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays(x) for x in columns), pa.array(hashes, pa.binary())], names=["id", "mark", "a", "b", "hashes"])

        return texts.mapInArrow(arrow_map(probe), fields)

    reached, now, hits = first.select("sentence"), first, None
    while left := now.count():
        blocks = 1 if left <= most else 2 * -(-left // most)  # blocks by hash are not equally large
        last = None
        for k in range(blocks):
            block = now if blocks == 1 else now.where(F.pmod(F.xxhash64("sentence"), F.lit(blocks)) == k)
            if blocks == 1 or not block.isEmpty():
                more = cut(compare(block))
                last = more if last is None else last.union(more)
        hits = last if hits is None else hits.union(last)
        new = last.where("b IS NOT NULL").groupBy(F.col("b").alias("sentence")).agg(F.min("hashes").alias("hashes"), F.min("a").alias("seed"))
        now = cut(new.join(reached, "sentence", "left_anti"))
        reached = reached.union(now.select("sentence"))
    if hits is None:
        return None
    return hits.where("b IS NOT NULL").select("a", "b").distinct(), hits.where("b IS NULL").select("id", "mark").distinct()


def _near(rows: DataFrame, block: int) -> DataFrame:
    """Verified links (a, b) between different sentences; ``rows``: sentence, words."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [x.split() for x in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        p = prints(np.array([_tokens[t] for t in chain.from_iterable(each)], np.uint64), np.cumsum(sizes) - sizes)
        octets = p.view(np.uint8).astype(np.int64)
        keys = (octets << 4) + (np.roll(octets, -1, axis=1) >> 4) + (np.arange(TABLES) << TABLE_BITS)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (keys, p.view(np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["class", "keys", "print"])

    signed = cut(rows.mapInArrow(arrow_map(sign), "class bigint, keys array<bigint>, print array<bigint>"))
    pairs = candidate_pairs(signed, RADIUS, block, PRINTS)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [alike(Counter(x.split()), Counter(y.split())) >= ALIKE for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    texts = rows.select(F.col("sentence").alias("a"), F.col("words").alias("words_a"))
    both = pairs.join(texts, "a").join(texts.toDF("b", "words_b"), "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(arrow_map(verify), "a bigint, b bigint")


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: list[tuple[str, str]] = SEEDS, block: int = 4096, every: bool = False, most: int = FRONTIER) -> DataFrame:
    """Documents with residue: ``doc_id``, residue_kind, how (``rule``, ``seed``, ``near_copy`` or ``copy``).

    ``seeds``: (kind, sentence), a few hundred; kind may be ``furniture``. how tells whether slots or Latin, only
    trusted sentences as they stand, near-copies of them, or a text with the same words decided. A text is looked at if a sentence of it is
    like a trusted one that is no furniture; its other sentences may be linked to those of further such texts. With ``every`` the sentences of all
    texts are compared, so texts are found as well that are linked to trusted residue only through sentences of other texts; ``most``: sentences
    that are broadcast at once for that. A first sentence of at most 14 words is a
    heading and does not count as content. Null ids are left out; null, empty and wordless texts
    carry nothing; repeated rows count once; an empty table gives no rows. Texts are read whole.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(Seeds(seeds))

    fields = ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS)

    def scan_for(rows: DataFrame, every: bool) -> DataFrame:
        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _sentences(batch.column(2).to_pylist(), known.value, every)
            at = pa.array([x[0] for x in found], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([x[k] for x in found], c[2]) for k, c in enumerate(_COLUMNS, 1))], names=["id", "mark", *(c[0] for c in _COLUMNS)])

        return cut(rows.mapInArrow(arrow_map(scan), f"id {kind}, mark bigint, {fields}"))

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    everything = scan_for(rows, False)
    copies = everything.where("copy IS NOT NULL").select("id", "copy").distinct()
    found = everything.where("copy IS NULL OR slots").drop("mark", "hashes", "sizes")
    spread = None
    if every:
        page = [k for k, (kind_, _) in enumerate(seeds) if kind_ == "furniture"]
        trusted = everything.where("seed >= 0 AND n > 0 AND latin = 0").where(~F.col("seed").isin(page)).groupBy("sentence").agg(F.min("words").alias("words"), F.max_by("seed", "likeness").cast("bigint").alias("seed"))
        trusted = cut(trusted.mapInArrow(arrow_map(_hashed), "sentence bigint, hashes binary, seed bigint"))
        spread = _spread(everything.where("copy IS NOT NULL").select("id", "mark", "hashes", "sizes"), trusted, known, most)
    if spread:
        new = cut(spread[1].join(everything.where("copy IS NULL").select("id", "mark").distinct(), ["id", "mark"], "left_anti"))
        found = found.union(scan_for(rows.join(new, ["id", "mark"], "left_semi"), True).where("copy IS NULL OR slots").drop("mark", "hashes", "sizes"))
    found = found.distinct()
    sentences = found.where("n > 0 AND latin = 0").groupBy("sentence").agg(F.min("words").alias("words"), F.max_by("seed", "likeness").alias("seed"))
    sentences = cut(sentences)
    label = F.element_at(F.array(*[F.lit(k) for k, _ in seeds]), F.col("seed") + 1)
    direct = sentences.where("seed >= 0").select("sentence", label.alias("own_label"), F.col("seed").cast("bigint").alias("seed"))
    # a seed is a node of its own: its number, which no sentence has
    links = _near(sentences.select("sentence", "words"), block).union(direct.select("sentence", F.col("seed")))
    if spread:
        links = links.union(spread[0])
    groups = cut(components(links, "a", "b"))
    votes = groups.join(direct, groups["id"] == direct["sentence"]).groupBy("component", "own_label").agg(F.count("*").alias("votes"))
    votes = votes.groupBy("component").agg(F.min_by("own_label", F.struct(-F.col("votes"), F.col("own_label"))).alias("group_label"))
    labels = sentences.select("sentence").join(direct.drop("seed"), "sentence", "left")
    labels = labels.join(groups.join(votes, "component").select(F.col("id").alias("sentence"), "group_label"), "sentence", "left")
    labels = labels.select("sentence", F.coalesce("own_label", "group_label").alias("label")).where("label IS NOT NULL")
    parts = found.join(labels, "sentence", "left")
    of = lambda kind: F.sum(F.when(F.col("label") == kind, F.col("n")).otherwise(0))
    heading = (F.col("rank") == 0) & (F.col("n") <= 14)
    plain = F.col("label").isNull() & (F.col("latin") == 0)
    by_text = parts.groupBy("id").agg(
        of("error_page").alias("err"), of("script_notice").alias("scr"), of("filler").alias("fil"), F.sum("latin").alias("lat"), F.sum("n").alias("all"), F.max("slots").alias("slots"),
        F.sum(F.when(plain & ~heading, F.col("n")).otherwise(0)).alias("other"), F.min(F.when(F.col("label").isNull() | (F.col("label") == "furniture") | (F.col("likeness") == 1), 1).otherwise(0)).alias("exact"),
    )
    script = (F.col("scr") > 0) & (2 * F.col("scr") >= F.col("err")) & (2 * F.col("other") <= F.col("scr"))
    error = (F.col("err") > 0) & (2 * F.col("other") <= F.col("err"))
    fill = F.col("fil") + F.col("lat")
    what = F.when(script, "script_notice").when(error, "error_page").when((fill >= 8) & (2 * fill >= F.col("all")), "filler").when(F.col("slots"), "placeholder")
    by_rule = (what == "placeholder") | ((what == "filler") & (F.col("lat") > F.col("fil")))
    how = F.when(by_rule, "rule").when(F.col("exact") == 1, "seed").otherwise("near_copy")
    own = cut(by_text.select("id", what.alias("residue_kind"), how.alias("how")).where("residue_kind IS NOT NULL"))
    per_copy = own.join(copies, "id").groupBy("copy", "residue_kind").agg(F.count("*").alias("votes"))
    per_copy = per_copy.groupBy("copy").agg(F.min_by("residue_kind", F.struct(-F.col("votes"), F.col("residue_kind"))).alias("residue_kind"))
    more = copies.join(per_copy, "copy").join(own.select("id"), "id", "left_anti").select("id", "residue_kind", F.lit("copy").alias("how"))
    return own.union(more).withColumnRenamed("id", "doc_id")
