"""Broken prompt and answer pairs, by a multi-label linear classifier.

Pairs become hashed n-grams of the whole answer plus features of the pair (overlap with the prompt, languages, form of
the end, stand-ins for nothing, words of declining, evidence of a cut). One logistic model with an output per defect is trained on the driver
from a bounded sample of pairs: sound ones as they are, and the same ones truncated, refused, copied, emptied or swapped
with an answer in another language. Thresholds are calibrated on held-out synthetic pairs. Every pair is then
scored, and the scores alone decide. Evidence of cuts is gathered over the whole tables (``truncation``); the synthetic cuts are
judged by the same statistics, so that its weight is learned as well.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import arrow_rows, cut
from loomline.llm import truncation
from loomline.llm.words import WORD, mix

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
FORM, PAIR, SPACE = 1 << 11, 1 << 12, 1 << 17  # slots of features of form, of these and those of the pair, of both and n-grams together
# Refusals show in the wording too; cuts show in form and in the statistics of all texts, not in length or what the pair shares.
SEES = np.zeros((SPACE, len(DEFECTS)), bool)
SEES[:PAIR], SEES[FORM:PAIR, 1], SEES[PAIR:, 2] = True, False, True
EVIDENCE = "evidence"  # the feature of a pair whose answer ``truncation`` takes for cut

# Frequent function words (fixed values) that tell the languages apart.
_COMMON = {
    "en": "a an i we our you your its they their what who how why where does do did could would should will please explain describe show apply apply tactic known the of and to in is that it for on with as was at by this be are from or an have not which after before every its because while when if both so".split(),
    "fr": "le la les des du une et est dans pour sur avec qui que au aux ce cette ces par pas plus nous vous sans chaque après avant lorsque dès j l d n s depuis cela ne puis je pouvez comment quand quel quelle quelles tant puisque".split(),
    "de": "der die das und ist nicht ein eine einen dem den des mit auf für von zu im am bei nach vor wie kann wird werden haben habe wir ich sie es dass wenn sich jeder jede aus als bis zum zur ohne weil welche".split(),
    "es": "el la de los las una unos y es en por para con del que se su al lo como más cada esta este esto sin hasta desde pero hemos he tras qué cómo cuando puede si sobre antes después según menos ha han todas".split(),
    "pt": "o a os as um uma e de do da dos das em no na nos nas para por com que se não ao mais cada este esta desta antes depois até sem também mas quando além disso foi são está".split(),
    "it": "il lo la gli le un una di del della dei delle che e è in nel nella per con non si al alla ogni questo questa prima dopo senza quando anche come sono più dal dalla".split(),
    "nl": "de het een van en is in op te dat die voor met niet aan zijn er ook maar bij om tot uit elke deze dit wanneer zonder na".split(),
}
# Scripts that tell a language by themselves: (name, first, last character)
_SCRIPTS = (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("devanagari", 0x900, 0x97F))
_LANG: dict[str, tuple[str, ...]] = {}
for _l, _w in _COMMON.items():
    for _x in _w:
        _LANG[_x] = (*_LANG.get(_x, ()), _l)

# Stand-ins for nothing (fixed values).
STAND_INS = frozenset("null none nil nan n/a na n.a. empty undefined blank void missing tbd <empty> <none> <null> <blank> (empty) (none) (blank) (null) [] {} () \"\" ''".split()) | {
    "(no answer)", "no answer", "<no answer>", "[no answer]", "(no response)", "no response", "no content", "(no content)", "not available", "keine antwort", "sin respuesta", "sans réponse", "pas de réponse",
    "[empty]", "[none]", "no output", "(no output)",
}


_MARKS = "\"'`*_.,:;!?¿¡()[]{}<>#|~-–—«»“”„"


def is_nothing(answer: str | None) -> bool:
    s = (answer or "").strip().strip("​﻿⁠ ").strip()
    return not s or s.lower() in STAND_INS or s.lower().strip("\"'`*.") in STAND_INS or not any(c.isalnum() for c in s)


def language(times: Counter, ascii_only: bool = False) -> tuple[str, int, int]:
    """(language or "", hits of it, hits of the next) of counted words by script and function words."""
    hits = dict.fromkeys(_COMMON, 0.0)
    for w in times.keys() & _LANG.keys():
        of = _LANG[w]
        for lang in of:
            hits[lang] += times[w] / len(of)  # words of several languages tell less
    if not ascii_only and times and max(map(max, times)) > "\u036f":
        for w, k in times.items():
            name = next((n for n, a, b in _SCRIPTS if a <= ord(w[0]) <= b), "")
            if name:
                hits[name] = hits.get(name, 0.0) + k
    first, second = sorted(hits.items(), key=lambda x: -x[1])[:2]
    return (first[0] if first[1] >= 1 and first[1] > second[1] + 0.5 else ""), int(first[1]), int(second[1])


def gives_back(prompt: list[str], answer: list[str]) -> int:
    """How many words stand before the prompt if the answer ends with it, at most one word short; else -1."""
    n, m = len(prompt), len(answer)
    if n < 3 or m < n - 1:
        return -1
    if answer[m - n :] == prompt and m >= n:
        return m - n
    short = answer[m - n + 1 :]
    k = next((i for i in range(n - 1) if short[i] != prompt[i]), n - 1)
    return m - n + 1 if short[k:] == prompt[k + 1 :] else -1


def copies(q: str, a: str, wq: list[str], wa: list[str]) -> int:
    """``gives_back``, also if the missing word is a path or composed of several."""
    if not wa or wa[-1] not in wq:
        return -1
    if (k := gives_back(wq, wa)) >= 0:
        return k
    return gives_back(*([w for w in (t.strip(_MARKS) for t in x.lower().split()) if w] for x in (q, a)))


def _bucket(n: int) -> str:
    return str(n) if n < 4 else str(4 + int(np.log2(n / 4) * 2))


class Pair:
    """A prompt and its answer with what features and checks share."""

    __slots__ = ("q", "a", "wq", "wa", "tq", "ta", "lq", "la", "copied", "state")

    def __init__(self, prompt: str | None, answer: str | None):
        self.q, self.a = prompt or "", answer or ""
        self.wq, self.wa = WORD.findall(self.q.lower()), WORD.findall(self.a.lower())
        self.tq, self.ta = Counter(self.wq), Counter(self.wa)
        self.lq, self.la = language(self.tq, self.q.isascii()), language(self.ta, self.a.isascii())
        self.copied, self.state = copies(self.q, self.a, self.wq, self.wa), truncation.state(self.a)


def pair_features(pair: Pair) -> list[str]:
    """Names of what the pair shows apart from the n-grams of its answer."""
    a, wa, wq = pair.a, pair.wa, pair.wq
    out = ["bias", f"words={_bucket(len(wa))}"]
    if is_nothing(a):
        out.append("nothing")
    how = pair.state
    out.append(f"state={how}")
    if how in ("open", "broken"):
        out.append(f"state={how}/{truncation.style(a)}")
    times, common = pair.ta, pair.tq.keys() & pair.ta.keys()
    extra = len(wa) - sum(times[w] for w in common)
    back = len(common) / len(pair.tq) if wq else 0.0
    out += [f"back={int(back * 10)}", f"extra={_bucket(extra)}", f"back/extra={int(back * 10)}/{_bucket(extra)}"]
    if pair.copied >= 0:
        out += ["gives_back", f"gives_back after {_bucket(pair.copied)}"]
    (lq, nq, sq), (la, na, sa) = pair.lq, pair.la
    if lq and la:
        sure = f"{min(nq - sq, 4)}{min(na - sa, 6)}"
        out += [f"lang={'same' if lq == la else 'other'}", f"lang={'same' if lq == la else 'other'}/{sure}"]
        if lq != la and na >= 2 and sa <= 0.6 * na and sq <= 0.6 * nq:
            out.append("lang_other_sure")
    if declines(a, times):
        out += ["declines", f"declines/words={_bucket(len(wa))}", f"declines/back={int(back * 4)}"]
    return out


_FORMS = ("bias", "state", "nothing", EVIDENCE)


class _Slot(dict):
    def __missing__(self, name: str) -> int:
        if len(self) > 50_000:
            self.clear()
        value = self[name] = xxhash.xxh3_64_intdigest(name) % FORM + (0 if name.startswith(_FORMS) else FORM)
        return value


_slot = _Slot()
_LETTERS = np.array([xxhash.xxh3_64_intdigest(x) | 1 for x in ("one", "two", "first", "first two")], np.uint64)


def _gram_slots(answers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of all n-grams of the answers: each token and pair of tokens, the first six once more by themselves."""
    found = [a.split() for a in answers]
    sizes = np.array([len(t) for t in found], np.int64)
    h = truncation.token_hashes(list(chain.from_iterable(found)))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner, at, edge = np.repeat(np.arange(len(found)), sizes), np.arange(len(h)), np.uint64(3)
    two = mix(h * _LETTERS[1] + mix(np.where(at > first, np.roll(h, 1), edge)))
    head = np.flatnonzero(at < first + 6)
    keys = np.concatenate((mix(h * _LETTERS[0]), two, mix(h[head] * _LETTERS[2]), mix(two[head] * _LETTERS[3])))
    return np.concatenate((owner, owner, owner[head], owner[head])), PAIR + (keys % np.uint64(SPACE - PAIR)).astype(np.int64)


def slots_of(some: list[Pair], more: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pair number, slot) of all features, each once a pair, by pair; ``more``: further features."""
    names = [pair_features(p) for p in some]
    for own, extra in zip(names, more or ()):
        own += extra
    owner, grams_ = _gram_slots([p.a for p in some])
    sizes = [len(x) for x in names]
    own = np.fromiter((_slot[x] for x in chain.from_iterable(names)), np.int64, sum(sizes))
    both = np.unique(np.concatenate((np.repeat(np.arange(len(some)), sizes) * SPACE + own, owner * SPACE + grams_)))
    return both // SPACE, both % SPACE


# Parts of declining answers, made up for training.
_OPEN = ["I'm sorry, but", "Sorry,", "Unfortunately,", "I apologize, but", "My apologies,", "Sadly", "As an AI model,", "As an assistant,", "Thanks for asking; however,", "I do not have access to that system, so", "I understand, but", "Regrettably,", ""]
_WILL = ["I can't", "I cannot", "I can’t", "I am unable to", "I'm not able to", "I won't be able to", "I will not", "I must decline to", "I'd rather not", "I am not allowed to", "I don't feel comfortable trying to", "I'm not permitted to", "it would not be appropriate for me to", "I have to refuse to", "I prefer not to"]
_DO = ["help with that", "assist with this request", "answer that", "answer here", "provide that information", "do what you describe", "carry out these steps", "discuss this topic", "go into this", "look into this for you", "share details on it", "continue with this", "respond to this question", "complete this task"]
_WHOLE = ["I have to pass on this one", "No comment on this from my side", "That falls outside of what I am allowed to do", "My guidelines keep me from answering here", "This is not something I will take on", "Sorry, no can do", "I decline", "That is against my policy", "I am not the right one to answer this"]
_AFTER = ["", "", "", "Thank you for your patience!", "If there is something else you need, just ask.", "Please reach out to your administrator.", "Consider asking a qualified person instead.", "Could we talk about a different step?", "Is there anything else I can do for you?"]
_DECLINE = {
    "fr": (["Je suis désolé,", "Désolé,", "Malheureusement,", "Je regrette,", ""], ["je ne peux pas répondre à cette question", "je ne peux pas vous aider sur ce point", "je ne suis pas autorisé à répondre", "je préfère ne pas traiter cette question", "je dois refuser cette demande", "cette question sort de mon domaine", "je ne suis pas en mesure d'aider", "il m'est impossible de répondre"], ["", "", "Merci de votre compréhension.", "Puis-je vous aider autrement ?"]),
    "de": (["Es tut mir leid,", "Leider", "Entschuldigung,", "Ich bedaure,", ""], ["dabei kann ich nicht helfen", "das darf ich nicht beantworten", "diese Anfrage muss ich ablehnen", "dazu darf ich keine Auskunft geben", "hier muss ich passen", "diese Aufgabe übernehme ich nicht", "ich kann diese Frage nicht beantworten", "ich bin dazu nicht befugt"], ["", "", "Bitte wenden Sie sich an eine andere Stelle.", "Kann ich sonst etwas tun?"]),
    "es": (["Lo siento,", "Disculpe,", "Lamentablemente,", "Me temo que", ""], ["no puedo ayudar con esa solicitud", "no puedo responder a esa pregunta", "no estoy autorizado a contestar", "prefiero no tratar este tema", "debo negarme", "esa petición queda fuera de mi alcance", "no me es posible ayudarle", "tengo que rechazar esta petición"], ["", "", "Gracias por su comprensión.", "¿Puedo ayudar con otra cosa?"]),
}
_INTRO = ["", "", "", "You asked:", "Your question was:", "Question:", "Thanks for the question.", "Hmm.", "Noted.", "Hi!", ">", "The question is:", "Vous avez demandé :", "Ihre Frage:", "Su pregunta:", "Good point, however:"]
_GREET = ["", "", "", "", "Hi! ", "Hmm. ", "Good point, however: "]


def _refuse(r: random.Random, lang: str) -> str:
    if lang in _DECLINE and r.random() < 0.85:
        first, main, after = _DECLINE[lang]
        s = f"{r.choice(first)} {r.choice(main)}.".strip()
        tail = r.choice(after)
    else:
        if r.random() < 0.3:
            s = r.choice(_WHOLE)
        else:
            s = f"{r.choice(_OPEN)} {r.choice(_WILL)} {r.choice(_DO)}".strip()
        s += r.choice([".", ".", ", and I hope you understand.", ""])
        tail = r.choice(_AFTER)
    s = r.choice(_GREET) + s[:1].upper() + s[1:] + (f" {tail}" if tail else "")
    return s.lower() if r.random() < 0.08 else s


def _copy(r: random.Random, q: str) -> str:
    t = q.split()
    if len(t) > 4 and r.random() < 0.35:
        del t[r.randrange(len(t))]
    s = " ".join(t) if r.random() < 0.5 or len(t) != len(q.split()) else q.strip()
    s = r.choice([s, s, s.rstrip("?.!"), s.rstrip("?.!") + ":", f'"{s}"', f"> {s}", s.upper(), s.lower(), f"**{s}**"])
    first = " ".join(r.choice(_INTRO) for _ in range(r.choice((1, 1, 1, 2, 3))))
    return f"{first} {s}".strip()


# Sound pairs that training always has, made up.
_BASE = [
    ("Which port does the service use?", "It uses port 8080 unless the configuration names another one."), ("How do I list the open files of a process?", "Run lsof with the id of the process and read the last column."),
    ("Pourquoi la tâche a-t-elle échoué ?", "La tâche a échoué parce que le disque était plein et que le journal ne pouvait pas être écrit."), ("Wie starte ich den Dienst neu?", "Der Dienst wird mit dem Befehl restart neu gestartet, sobald die Sperre frei ist."),
    ("¿Dónde se guarda el registro?", "El registro se guarda en la carpeta del servicio y se rota cada noche por la tarea programada."), ("Is the cache shared between hosts?", "No."), ("Does the build need the network?", "Yes, but only for the first run of the day."),
]


def sound_pairs(sample: list[tuple], evident: set) -> list[tuple]:
    """Of (id, prompt, answer) those without a sign of a defect, with the language: (id, prompt, answer, language)."""
    out = []
    for i, q, a in [*((None, *x) for x in _BASE), *sample]:
        pair = Pair(q, a)
        lq, la = pair.lq[0], pair.la[0]
        odd = i in evident or is_nothing(a) or pair.copied >= 0 or (lq and la and lq != la) or pair.state == "broken" or not pair.wq
        if not odd and pair.state == "open" and truncation.style(a) != "line":
            odd = True
        if not odd and declines(a, pair.ta) and len(pair.wa) < 40:
            odd = True
        if not odd:
            out.append((i, q, a, lq or la))
    return out


def cuts_of(sound: list[tuple], seed: int = 5) -> list[tuple[str, str]]:
    """(prompt, answer cut at a random place) of sound pairs."""
    r = random.Random(seed)
    out = []
    for _, q, a, _ in sound:
        if len(a) > 30:
            out += [(q, c) for c in (a[: r.randrange(12, len(a) - 1)] for _ in range(2)) if truncation.state(c) in ("open", "broken")]
    return out


def synthetic(sound: list[tuple], cuts: list[tuple[str, str, bool]], seed: int = 11) -> list[tuple[str, str, bool, int]]:
    """(prompt, answer, evidence of a cut, defect number or -1) of sound pairs and of pairs broken on purpose."""
    r = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for _, q, a, lang in sound:
        if language(Counter(WORD.findall(a.lower())))[1] >= 3:
            by_lang.setdefault(lang, []).append(a)
    out = [(q, a, evident, 1) for q, a, evident in cuts]
    for _, q, a, lang in sound:
        out.append((q, a, False, -1))
        roll = r.random()
        if roll < 0.12:  # the prompt as a heading of a real answer is sound, and so is an answer that names it last
            out.append((q, f"{q.strip().rstrip('?.!')}: {a}", False, -1))
        elif roll < 0.2 and len(WORD.findall(a)) >= 20:
            out.append((q, f"{a} {q.strip()}", False, -1))
        if 0.3 < roll < 0.6:  # words never seen before are no sign of a defect
            out.append((q, re.sub(r"[^\W\d]{3,}", lambda m: "".join(r.choice("abdefghiklmnoprstuvz") for _ in m[0]), a), False, -1))
        if roll < 0.5:
            out.append((q, _refuse(r, lang), False, 2))
        if roll < 0.06:  # refusals may be long and name what was asked
            words_ = " ".join(_refuse(r, lang) for _ in range(r.randrange(3, 9)))
            out.append((q, f"{words_} {r.choice(('This is about', 'See', 'You named'))} {r.choice(q.split() or ['/'])} and/or /a/b.", False, 2))
        if len(WORD.findall(q)) >= 3 and r.random() < 0.5:
            out.append((q, _copy(r, q), False, 3))
        others = [x for x in by_lang if x and x != lang]
        if lang and others and r.random() < 0.5:
            out.append((q, r.choice(by_lang[r.choice(others)]), False, 4))
        if r.random() < 0.15:
            out.append((q, r.choice(["", " ", "\n", "\u200b", "...", *sorted(STAND_INS)]), False, 0))
    for s in ("Yes.", "No.", "Unknown.", "In most cases, yes.", "Only on some hosts.", "Not yet.", "Sí.", "Oui.", "Nein.", "No, not by policy alone.", "Yes, but only on older builds.", "42", "Done."):
        for _, q, _, _ in sound[:40]:
            out.append((q, s, False, -1))
    r.shuffle(out)
    return out


# Words of declining, any of which a refusal has.
_DECLINING = re.compile(
    r"(?i)\b(?:can(?:'t|’t|not)|unable|not able|won(?:'t|’t)|will not|declin\w+|rather not|prefer not|not allowed|not permitted|not authorized|comfortable|appropriate|pass on|no comment|guidelines|policy|take on|outside of what|no can do"
    r"|refus\w+|désolé\w*|ne peux|ne suis pas|préfère ne pas|sort de mon|impossible de|regrette|tut mir leid|nicht helfen|nicht beantworten|ablehnen|ablehne|keine auskunft|muss ich passen|übernehme ich nicht|befugt|darf ich nicht"
    r"|lo siento|disculpe|no puedo|no estoy|prefiero no|negarme|fuera de mi|rechaz\w+|no me es posible|sinto muito|não posso|mi dispiace|non posso|helaas|kan ik niet)\b"
)


# Words one of which every match has, or both of a pair, or the start of one.
_DECLINE_SIGNS = frozenset(
    "cannot unable rather authorized comfortable appropriate guidelines policy outside préfère impossible regrette leid helfen beantworten ablehnen ablehne auskunft passen übernehme befugt darf"
    " siento disculpe puedo estoy prefiero negarme sinto posso dispiace helaas kan".split()
)
_DECLINE_PAIRS = (("t", "can"), ("t", "won"), ("not", "will"), ("not", "able"), ("not", "prefer"), ("not", "allowed"), ("not", "permitted"), ("no", "comment"), ("no", "can"), ("on", "pass"), ("on", "take"), ("ne", "peux"), ("ne", "suis"), ("mon", "sort"), ("mi", "fuera"), ("me", "posible"))
_DECLINE_STEMS = ("declin", "refus", "rechaz", "désolé")


def declines(text: str, times: Counter) -> bool:
    """Whether a text has words of declining; ``times``: its counted words in lower case."""
    if times.keys().isdisjoint(_DECLINE_SIGNS) and not any(x in times and y in times for x, y in _DECLINE_PAIRS):
        low = text.lower()
        if not any(x in low for x in _DECLINE_STEMS):
            return False
    return _DECLINING.search(text) is not None


class PairModel:
    """One logistic model per defect over hashed features, with calibrated thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def train(cls, data: list[tuple[str, str, bool, int]], epochs: int = 4, precision: float = 0.95) -> PairModel:
        """From ``synthetic``."""
        slots: list[np.ndarray] = []
        for lo in range(0, len(data), 1000):  # pairs are much larger than their slots
            part = data[lo : lo + 1000]
            owner, slot = slots_of([Pair(q, a) for q, a, _, _ in part], [[EVIDENCE] if x else [] for _, _, x, _ in part])
            slots += np.split(slot.astype(np.int32), np.searchsorted(owner, np.arange(1, len(part))))
        labels = np.array([y for *_, y in data])
        held = np.arange(len(data)) % 5 == 0
        w = np.zeros((SPACE, len(DEFECTS)))
        g = np.full((SPACE, len(DEFECTS)), 1e-3)
        train = np.flatnonzero(~held)
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            rng.shuffle(train)
            for at in range(0, len(train), 128):
                rows = train[at : at + 128]
                idx = np.concatenate([slots[i] for i in rows])
                starts = np.cumsum([0, *[len(slots[i]) for i in rows[:-1]]])
                z = np.add.reduceat(w[idx], starts, axis=0)
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - (labels[rows][:, None] == np.arange(len(DEFECTS)))
                order = np.argsort(idx, kind="stable")
                u, first = np.unique(idx[order], return_index=True)
                grad = np.add.reduceat(np.repeat(err, [len(slots[i]) for i in rows], axis=0)[order], first, axis=0) * SEES[u]
                g[u] += grad**2
                w[u] -= 0.25 * grad / np.sqrt(g[u])
        z = np.array([w[slots[i]].sum(axis=0) for i in np.flatnonzero(held)])
        return cls(w.astype(np.float32), np.array([_threshold(z[:, k], labels[held], k, precision) for k in range(len(DEFECTS))]))

    @property
    def evidence(self) -> float:
        """What evidence adds to the score of truncation."""
        return float(self.weights[_slot[EVIDENCE], 1])

    def scores(self, some: list[Pair]) -> np.ndarray:
        """Scores over the thresholds, a row a pair, without evidence."""
        owner, slot = slots_of(some)
        starts = np.searchsorted(owner, np.arange(len(some)))  # every pair has a feature
        return np.add.reduceat(self.weights[slot], starts, axis=0) - self.thresholds


def _threshold(z: np.ndarray, labels: np.ndarray, k: int, precision: float, rarity: float = 100.0) -> float:
    """The lowest score from which on at least ``precision`` of the held-out pairs have the defect.

    Synthetic defects are far more common than real ones, so a sound pair counts ``rarity`` times.
    """
    if not (labels == k).any():
        return np.inf
    order = np.argsort(-z)
    true = np.cumsum(labels[order] == k)
    share = true / (true + np.cumsum(np.where(labels[order] < 0, rarity, labels[order] != k)))
    good = np.flatnonzero(share >= precision)
    last = int(good[-1]) if len(good) else 0
    here = z[order[last]]
    below = z[order[last + 1]] if last + 1 < len(z) else here
    return float((here + below) / 2)


def records(df: DataFrame, name: str, key: Column, turns: str, source: Column) -> DataFrame:
    """Rows of one table as (table_name, record_id, source, turns)."""
    t = F.transform(F.col(turns), lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role")))
    rows = df.where(key.isNotNull() & F.col(turns).isNotNull())  # on the columns themselves, so that counting needs no texts
    return rows.select(F.lit(name).alias("table_name"), key.cast("string").alias("record_id"), source.cast("string").alias("source"), t.alias("turns"))


def sample_pairs(rows: DataFrame, most: int) -> list[tuple[tuple, str, str]]:
    """((id, turn), prompt, answer) of the pairs of about ``most`` records, taken by their hashes; at most 4 * ``most`` pairs."""
    share = min(1.0, most / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("id", "turns").limit(2 * most)
    out = []
    for r in some.toLocalIterator():
        for k, (a, b) in enumerate(zip(r.turns, r.turns[1:]), 1):
            if a and b and a.role == "user" and b.role == "assistant" and a.content and b.content:
                out.append(((r.id, k), a.content, b.content))
    return sorted(out)[: 4 * most]


def broken_pairs(rows: DataFrame, sample_size: int = 3000) -> DataFrame:
    """Defective pairs: table_name, record_id, turn_index (of the answer), defect, score.

    ``rows``: from ``records``. A pair is a user turn directly followed by an assistant turn. It has at
    most one defect: that with the highest score over its threshold. Null answers are empty; null prompts can be neither
    copied nor in a language; null turns and roles make no pairs; repeated rows count once; an empty table gives no
    rows. Training reads about ``sample_size`` records; all else covers every pair.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("id", F.concat_ws("\x00", "table_name", "record_id"))
    sample = sample_pairs(rows, sample_size)
    cuts_made = cuts_of(sound_pairs(sample, set()))
    probes = spark.createDataFrame([(f"probe {k}", None, [(a,)]) for k, (_, a) in enumerate(cuts_made)], "id string, source string, turns array<struct<content:string>>")
    # statistics, limits and longer copies are those of all turns; the join keeps the answers of pairs
    source = F.when(F.col("source").isNotNull(), F.concat_ws("\x00", "table_name", "source"))
    ends = rows.select("id", source.alias("source"), "turns")
    cuts = cut(truncation.truncated_turns(ends, "id", "turns", "source", probes).where("reason IS NOT NULL").select("id", "turn_index").distinct())
    known = spark.createDataFrame([*{i for (i, _), _, _ in sample}, *[f"probe {k}" for k in range(len(cuts_made))]] or [""], "string").withColumnRenamed("value", "id")
    evident = {(r.id, r.turn_index) for r in cuts.join(F.broadcast(known), "id", "left_semi").toLocalIterator()}  # of the sample and the probes
    sound = sound_pairs(sample, evident)
    model = spark.sparkContext.broadcast(PairModel.train(synthetic(sound, [(q, a, (f"probe {k}", 0) in evident) for k, (q, a) in enumerate(cuts_made)])))

    def score(batches):
        most = max(model.value.evidence, 0.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                keys, some = [], []
                names, ids, lists = (batch.column(i).slice(lo, 512) for i in range(3))
                content, role = (x.to_pylist() for x in lists.flatten().flatten())  # null turns have neither
                at = 0
                for name, rec, size in zip(names.to_pylist(), ids.to_pylist(), lists.value_lengths().to_pylist()):
                    for k in range(at + 1, at + (size or 0)):
                        if role[k - 1] == "user" and role[k] == "assistant":
                            keys.append((name, rec, k - at)), some.append(Pair(content[k - 1], content[k]))
                    at += size or 0
                if not some:
                    continue
                z = model.value.scores(some).astype(np.float64)
                z[~np.isfinite(z)] = -99.0  # a defect that training never saw
                rest = z.copy()
                rest[:, 1] = -99.0
                best, top = rest.argmax(axis=1), rest.max(axis=1)
                at = np.flatnonzero((top >= 0) | (z[:, 1] + most >= 0))
                if len(at):
                    cols = [pa.array([keys[i][j] for i in at], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                    cols += [pa.array([DEFECTS[best[i]] for i in at]), pa.array(top[at]), pa.array(z[at, 1])]
                    yield pa.RecordBatch.from_arrays(cols, names=["table_name", "record_id", "turn_index", "other", "other_score", "cut_score"])

    with arrow_rows(spark, truncation.BATCH):
        found = cut(rows.select("table_name", "record_id", "turns").mapInArrow(score, "table_name string, record_id string, turn_index int, other string, other_score double, cut_score double")).distinct()
    out = found.withColumn("id", F.concat_ws("\x00", "table_name", "record_id")).join(cuts.withColumn("evident", F.lit(model.value.evidence)), ["id", "turn_index"], "left")
    cut_score = F.col("cut_score") + F.coalesce("evident", F.lit(0.0))
    score_ = F.greatest("other_score", cut_score)
    defect = F.when(cut_score > F.col("other_score"), F.lit("truncated")).otherwise(F.col("other"))
    return out.select("table_name", "record_id", "turn_index", defect.alias("defect"), score_.alias("score")).where("score >= 0")
