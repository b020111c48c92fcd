import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import components, leakage, neardup, packing, pairs, repetition, residue, truncation
from loomline.llm import words as Wd

WORD = re.compile(r"[^\W_]+")
VOCAB = [f"word{k}" for k in range(400)]


def text(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


# words


def test_grams_tell_order_and_length():
    h = Wd.hash_words(["a", "b", "a", "b", "c"])
    g = Wd.grams(h, 2)
    assert g[0] == g[2] and g[0] != g[1] and len(Wd.grams(h, 6)) == 0
    assert Wd.words(None) == [] and Wd.words("Don't_x É9") == ["don", "t", "x", "é9"]


def test_chunks_cover_all_once():
    texts = ["x" * n for n in (5, 0, 30, 1, 1)] + [None]
    parts = list(Wd.chunks(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6))
    assert list(Wd.chunks([])) == []


# repetition


def brute_share(t, n=4):
    w = WORD.findall((t or "").lower())
    seen, inside = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            inside |= set(range(i, i + n))
        seen.add(g)
    return len(w), len(inside)


def test_repetition_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, t, "s") for i, t in enumerate([None, "", "...", "a b c", "a a a a a a a", *[text(r, 30) + " " + text(random.Random(1), k) * 2 for k in range(8)], "x y z w " * 5000])]
    df = spark.createDataFrame(rows + rows[:2], "id int, t string, share string")  # repeats; a column that clashes with a result
    got = repetition.repetition_shares(df, "id", F.col("t"), {"g": F.col("share")}).collect()
    assert len(got) == len(rows) + 2
    want = {i: brute_share(t) for i, t, _ in rows}
    assert all((x.n_words, x.n_repeated) == want[x.id] and x.g == "s" for x in got)
    assert repetition.repetition_shares(df.limit(0), "id", F.col("t")).count() == 0


def test_binomial_bound_is_exact():
    assert repetition.binomial_upper(0, 50, 0.05) == pytest.approx(1 - 0.05 ** (1 / 50), abs=1e-9)
    assert repetition.binomial_upper(5, 5, 0.05) == 1.0 and repetition.binomial_upper(0, 0, 0.1) == 1.0
    from math import comb

    p = repetition.binomial_upper(3, 40, 0.02)
    assert sum(comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(4)) == pytest.approx(0.02, rel=1e-6)


def test_cutoffs_are_safe(spark):
    r = random.Random(5)
    rows = [("big", r.random() * 0.2, False) for _ in range(5000)] + [("big", 0.5 + r.random() / 2, True) for _ in range(100)] + [("small", 0.1, False)] * 5 + [(None, 0.3, False)] * 3 + [("big", None, False), ("big", 0.1, None)]
    df = spark.createDataFrame(rows, "stratum string, share double, bad boolean")
    cutoffs = repetition.risk_cutoffs(df, "stratum", "share", "bad")
    got = {x.stratum: x for x in cutoffs.collect()}
    assert got["small"].cutoff is got["(null)"].cutoff is None and got["small"].bound == 1
    assert 0.19 <= got["big"].cutoff <= 0.21 and got["big"].bound <= 0.01 and got["big"].missed == 0 and got["big"].n_good == 5000
    assert got["(all)"].n_good == 5008 and got["(all)"].cutoff == got["big"].cutoff
    assert repetition.risk_cutoffs(df.limit(0), "stratum", "share", "bad").count() == 0
    flagged = repetition.flag_repetitive(df, cutoffs, "stratum")
    assert flagged.where("bad AND flagged").count() == 100
    assert {x.cutoff for x in flagged.where("stratum = 'small'").collect()} == {got["(all)"].cutoff}
    assert repetition.flag_repetitive(df, cutoffs.limit(0), "stratum").where("flagged").count() == 0
    # the cutoffs decide
    assert repetition.flag_repetitive(df, cutoffs.withColumn("cutoff", F.lit(0.75)), "stratum").where("flagged").count() < 100


def test_trials_have_the_share_they_were_made_with(spark):
    r = random.Random(8)
    for k in range(300):
        h = np.array([r.getrandbits(64) for _ in range(r.randrange(16, 200))], np.uint64)
        doc, bad = repetition.trial(h, 4, 0.4, r)
        inside = repetition.repeated(doc, np.array([len(doc)]), 4)
        assert (5 * int(inside.sum()) >= 2 * len(doc)) == bad
    assert repetition.trial(h[:15], 4, 0.4, r) is None
    rows = [(i, "s" if i % 2 else None, t) for i, t in enumerate([None, "", "a b a b a b a b", *[text(r, 60) + " " + text(random.Random(1), k) * 2 for k in range(40)]])]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    per = {x.stratum: x.trials for x in repetition.trials_per_row(df, F.col("s"), 8, 0.01, 0.05, 0.6).collect()}
    assert set(per) == {"s", "(null)"} and per["s"] > 50
    got = repetition.repetition_shares(df, "id", F.col("t"), {"s": F.col("s")}, trials=F.lit(100)).collect()
    assert all(x.trials == [] for x in got if x.id < 3) and all(len(x.trials) == 100 and all((y.share >= 0.4) == y.bad for y in x.trials) for x in got if x.id >= 3)
    assert {x.id: (x.n_words, x.n_repeated) for x in got} == {i: brute_share(t) for i, _, t in rows}
    labelled = spark.createDataFrame([(x.s, y.share, y.bad) for x in got for y in x.trials], "s string, share double, bad boolean")
    assert {x.cutoff for x in repetition.risk_cutoffs(labelled, "s", "share", "bad").collect()} == {0.4}


# packing


def test_pretokens_follow_the_published_pattern(spark):
    import regex

    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    r = random.Random(2)
    alphabet = "ab É9½'’\"st \t\n  　_-😀\x1c"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(300)] + ["", "it's we'll  go\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packing.pretoken_count(F.col("t")).alias("n")).collect()
    assert all(x.n == len(pattern.findall(x.t)) for x in got)
    assert spark.range(1).select(packing.pretoken_count(F.lit(None).cast("string")).alias("n")).first().n == 0


def test_fullest_equals_brute_force():
    from itertools import product

    r = random.Random(4)
    for _ in range(60):
        sizes = r.sample(range(1, 30), 4)
        counts = {s: r.randrange(1, 4) for s in sizes}
        total = r.randrange(1, 60)
        best = max(x for ks in product(*[range(counts[s] + 1) for s in sizes]) if (x := sum(k * s for k, s in zip(ks, sizes))) <= total)
        got = packing.fullest(total, sizes, counts)
        assert sum(s * k for s, k in got.items()) == best and all(k <= counts[s] for s, k in got.items())


def test_packing_invariants(spark):
    r = random.Random(7)
    docs = [(i, r.choice([3, 49, 49, 49, 99, 100, 101, 250, 0, 7, 1000])) for i in range(800)] + [(None, 5), (5, 5), (5, 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, size bigint").withColumn("cost", F.lit("clash"))
    profiles = spark.createDataFrame([(1, "a", 100, 1), (2, "b", 64, 2), (2, "b", 64, 2)], "profile_id int, profile_name string, capacity_tokens bigint, separator_tokens bigint")
    rows = packing.pack(df, profiles, "doc_id", F.col("size"), salts=5).toPandas()
    for profile, cap, sep in ((1, 100, 1), (2, 64, 2)):
        p = rows[rows.profile_id == profile]
        used = p.groupby("container").cost.sum()
        assert used.max() <= cap and len(used) == used.index.max() + 1
        # every token and separator is there: tokens plus one separator a piece
        assert p.cost.sum() == sum(s for _, s in docs) + sep * len(p)
        split = {d for d, s in docs if s + sep > cap}
        assert set(p[p.n_pieces > 1].doc_id) == split
        if profile == 1:
            assert len(used) <= 1.02 * p.cost.sum() / cap
    assert packing.pack(df.limit(0), profiles, "doc_id", F.col("size")).count() == 0
    assert packing.pack(df, profiles.limit(0), "doc_id", F.col("size")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([(1, 2, 2)], "profile_id int, capacity_tokens bigint, separator_tokens bigint"), "doc_id", F.col("size"))


# leakage


def brute_leaks(docs, items, n=13):
    grams = {}
    for k, t in items:
        w = WORD.findall((t or "").lower())
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i in range(len(w) - n + 1):
            out |= {(d, k) for k in grams.get(tuple(w[i : i + n]), ())}
    return out


def leak_tables(spark):
    r = random.Random(9)
    items = [(k, text(r, 20 + k)) for k in range(12)] + [(20, "too short"), (21, None), (22, "")]
    items.append((13, items[3][1] + " more " + text(r, 5)))
    docs = []
    for d in range(60):
        w = text(r, 40).split()
        if d % 3 == 0:
            source = items[d % 12][1].split()
            part = source[2 : 2 + 11 + d % 5]
            sep = r.choice([" ", ", ", "\n- "])
            w = w[:10] + [sep.join(part).upper()] + w[10:]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "x" * 100_000), (103, items[0][1] + "! " + items[0][1])]
    return docs, items, spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("most", [10**9, 20_000])
def test_leaks_equal_brute_force(spark, most):
    docs, items, d, i = leak_tables(spark)
    spans = leakage.leaked_spans(d, i, most_bytes=most)
    assert {(x.doc_id, x.item_id) for x in spans.collect()} == brute_leaks(docs, items)
    twice = sorted((x.first_word, x.last_word) for x in spans.where("doc_id = 103 AND item_id = 0").distinct().collect())
    assert twice == [(0, 39)]  # spans that touch are one
    assert leakage.leaked_spans(d.limit(0), i, most_bytes=most).count() == 0
    if most < 10**6:  # several blocks
        assert "Union" in spans._jdf.queryExecution().toString()
    assert leakage.leaked_spans(d, i.limit(0), most_bytes=most).count() == 0


def test_item_index_is_small():
    import pickle

    r = random.Random(4)
    index = leakage.ItemIndex([(k, text(r, 500)) for k in range(200)], 13)
    assert len(pickle.dumps(index)) < leakage.BYTES_A_WORD * 100_000 + leakage.BYTES_A_NAME * len(VOCAB)


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d, then keep that."), (2, "a b c d"), (3, "none")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id bigint, text string")
    got = {x.doc_id: x for x in leakage.remove_spans(docs, leakage.leaked_spans(docs, items, n=4)).collect()}
    assert set(got) == {1, 2} and got[1].clean_text == "Keep this. , then keep that." and got[2].action == "dropped" and got[2].clean_text is None


# near duplicates


def brute_pairs(rows, n, t):
    sets = {}
    for k, x in rows:
        w = WORD.findall((x or "").lower())
        if len(w) >= n:
            sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


def near_rows():
    r = random.Random(11)
    rows = []
    for g in range(25):
        base = text(r, 120)
        rows += [(f"{g}-{v}", edited(r, base, v)) for v in range(6)]
    rows += [("copy-1", rows[0][1].upper()), ("copy-2", rows[0][1].replace(" ", "\n")), ("short", "a b"), ("none", None), ("empty", ""), ("tiny-1", "one two three"), ("tiny-2", "One, two: three")]
    return rows


@pytest.mark.parametrize("n, t, block", [(3, 0.6, 4096), (3, 0.6, 4), (5, 0.8, 4096)])
def test_near_duplicates_equal_brute_force(spark, n, t, block):
    rows = near_rows()
    df = spark.createDataFrame(rows + rows[:4] + [(None, rows[0][1])], "run_id string, text string").withColumn("class", F.lit(1))
    pairs_ = neardup.id_pairs(*neardup.near_duplicates(df, "run_id", F.col("text"), n=n, threshold=t, block=block)).collect()
    got = {(x.id_a, x.id_b) for x in pairs_}
    assert got == brute_pairs(rows, n, t) and len(pairs_) == len(got)
    members, links = neardup.near_duplicates(df.limit(0), "run_id", F.col("text"), n=n, threshold=t)
    assert members.count() == 0 and links.count() == 0


def test_hot_group_of_copies_is_one_class(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(text(random.Random(1), 80))).otherwise(F.concat(F.lit("unlike "), F.sha2(F.col("id").cast("string"), 256), F.lit(" other words "), "id", F.lit(" end of it"))).alias("t"))
    members, links = neardup.near_duplicates(df, "id", F.col("t"), n=3, threshold=0.6)
    assert members.groupBy("class").count().agg(F.max("count")).first()[0] == 1000 and links.count() == 0


def test_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (20, 3), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (200, 3, 12), dtype=np.uint64)
    points = np.repeat(base, 10, axis=0) ^ np.bitwise_xor.reduce(flips, axis=2)
    for radius in (0, 20, 64, 120):
        got = set()
        for x, y in neardup.tree_pairs(points, points[::2], radius):
            got |= set(zip(x.tolist(), y.tolist()))
        d = np.bitwise_count(points[:, None] ^ points[::2][None]).sum(axis=2)
        assert got == set(zip(*(v.tolist() for v in np.nonzero(d <= radius))))


@pytest.mark.parametrize("few, hub", [(10**6, 10**6), (0, 10**6), (0, 20)])
def test_components(spark, monkeypatch, few, hub):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    r.shuffle(links)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


# truncation


def talk(*contents):
    return [(c, "user" if k % 2 == 0 else "assistant") for k, c in enumerate(contents)]


@pytest.mark.parametrize(
    "t, want",
    [("All done.", "done"), ("Is it?", "done"), ("It says 'so.'", "done"), ('{"a": 1}', "done"), ('{"a": "cut he', "broken"), ("```sh\nls", "broken"), ("```sh\nls\n```", "done"), ("root@x:/tmp$", "done"), ("stops in the mid", "open"), (" ", "empty"), (None, "empty")],
)
def test_state(t, want):
    assert truncation.state(t) == want


def cut_rows():
    r = random.Random(6)
    nouns, verbs, ends = ["server", "window", "garden", "letter", "engine"], ["opens", "closes", "repairs", "watches"], ["today", "tomorrow", "again", "quickly"]
    sentence = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} near the {r.choice(nouns)} {r.choice(ends)}."
    rows, cuts = [], set()
    for k in range(300):
        a, b = " ".join(sentence() for _ in range(6)), " ".join(sentence() for _ in range(12))
        source = "limited" if k % 3 == 0 else "free"
        if k % 3 == 0:
            b = b[:200]
            if not b.endswith("."):
                cuts.add((f"r{k}", 1))
        elif k % 50 == 1:
            b = b[:173] + " ga"
            cuts.add((f"r{k}", 1))
        rows.append((f"r{k}", source, talk(a, b)))
    rows += [("null", None, None), (None, "free", talk("a", "b")), ("blank", "free", talk(" ", "")), ("nulls", "free", [(None, None)]), *[(f"lists{k}", "free", talk("Give the list.", "- " + "\n- ".join(r.sample(nouns, 4)))) for k in range(60)]]
    return rows, cuts


def test_cut_turns(spark):
    rows, cuts = cut_rows()
    schema = "run_id string, trace_source string, conversations array<struct<content:string,role:string>>, source string"
    df = spark.createDataFrame([(*x, "clash") for x in rows + rows[:5]], schema)
    got = truncation.truncated_turns(df, "run_id", "conversations", "trace_source").where("reason IS NOT NULL").collect()
    found = {(x.id, x.turn_index) for x in got}
    assert cuts <= found and len(found - cuts) <= 3
    assert {x.reason for x in got if x.source == "limited"} == {"limit"}
    assert not any(i.startswith("lists") for i, _ in found)
    assert truncation.truncated_turns(df.limit(0), "run_id", "conversations", "trace_source").count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_longer_copy(spark, monkeypatch, most):
    monkeypatch.setattr(truncation, "BROADCAST_PREFIXES", most)
    whole = "Kappa lambda omicron sigma upsilon rhomboid zetetic quorum vellum parsec."
    rows = [("a", "s", talk("x.", whole)), ("b", "s", talk("x.", whole[:52])), ("c", "s", talk("x.", whole[:-1]))]
    df = spark.createDataFrame(rows, "run_id string, trace_source string, conversations array<struct<content:string,role:string>>")
    got = {(x.id, x.reason) for x in truncation.truncated_turns(df, "run_id", "conversations", "trace_source").where("reason = 'longer_copy'").collect()}
    assert got == {("b", "longer_copy")}


@pytest.mark.parametrize("most", [10**6, 0])
def test_longer_copy_of_a_short_value(spark, monkeypatch, most):
    monkeypatch.setattr(truncation, "BROADCAST_PREFIXES", most)
    rows = [("a", "s", talk("x.", "Can you check whether events zeta hold?")), ("cut", "s", talk("x.", "Can you check whether eve")), ("whole", "s", talk("x.", "Can you check whether events zeta hold")), ("dash", "s", talk("- a thing", "-")), ("next", "s", talk("Ready Steady.", "Ready"))]
    df = spark.createDataFrame(rows, "run_id string, trace_source string, conversations array<struct<content:string,role:string>>")
    got = {x.id for x in truncation.truncated_turns(df, "run_id", "conversations", "trace_source").where("reason = 'longer_copy'").collect()}
    assert got == {"cut"}


def test_common_words_are_those_of_all_files(spark):
    rows = [(f"r{k}", "s", talk("Go on.", f"It is kept in the place{k}.")) for k in range(60)] + [(f"q{k}", "s", talk("Go on.", f"It is in the quorumwise store {k}.")) for k in range(6)]
    rows.append(("cut", "s", talk("Go on.", "All of it is kept in the quorumwi")))
    df = spark.createDataFrame(rows, "run_id string, trace_source string, conversations array<struct<content:string,role:string>>")
    for parts in (1, 7):
        got = truncation.truncated_turns(df.repartition(parts, F.col("run_id")), "run_id", "conversations", "trace_source").where("id = 'cut' AND turn_index = 1").collect()
        assert [x.reason for x in got] == ["phrase"] and got[0].chance > 0.25


# pairs


def test_copies():
    q = "Which tool turns does anchor-corgal still need?"
    for a in (q, f'"{q}"', "You asked: " + q, q.upper(), "Which tool turns does still need?", "Which tool turns does anchor-corgal need?"):
        assert pairs.Pair(q, a).copied >= 0, a
    long = "You have asked me the following, and before anything else I would like to state it once more as it came in: "
    assert pairs.Pair(q, long + q).copied == 22
    for a in ("", "It needs three of them.", q + " It needs three of them, the first and the last.", "Which tool does need?"):
        assert pairs.Pair(q, a).copied < 0, a


def test_nothing_and_languages():
    assert all(pairs.is_nothing(x) for x in (None, "", " \n", "​", "N/A", "null", "(no answer)", "...", "—", "{}", '""'))
    assert not any(pairs.is_nothing(x) for x in ("No.", "Yes.", "42", "Unknown.", "nullify it"))
    lang = lambda s: pairs.language(Counter(WORD.findall(s.lower())))[0]
    assert [lang(s) for s in ("The agent reads the file and stops.", "Le module lit le fichier et la ligne.", "Der Dienst liest die Datei und das Blatt.", "El módulo lee el archivo y la línea.", "O leitor não move o arquivo na linha.", "Модуль читает файл.", "xyz")] == ["en", "fr", "de", "es", "pt", "cyrillic", ""]


def pair_table(spark):
    r = random.Random(8)
    nouns = ["cache", "queue", "socket", "marker", "ledger", "runner", "script", "filter"]
    say = lambda: f"The {r.choice(nouns)} of node {r.randrange(90)} checks the {r.choice(nouns)} and then it writes line {r.randrange(900)} of the {r.choice(nouns)} file."
    rows = [(f"ok{k}", talk(f"How does the {r.choice(nouns)} number {k} handle the {r.choice(nouns)}?", " ".join(say() for _ in range(3)))) for k in range(300)]
    rows += [(f"es{k}", talk(f"¿Cómo se revisa el módulo {k} en la línea de la cola?", "El módulo revisa la cola en la línea y el archivo. La tarea copia el archivo en la cola.")) for k in range(40)]
    ask = "How does the cache number 5 handle the queue?"
    bad = {"empty": [None, "", "N/A", "..."], "copied_question": [ask, f"> {ask}"], "refusal": ["I'm sorry, but I can't help with that.", "Unfortunately, I am not allowed to answer here."], "other_language": ["El módulo revisa la cola en la línea y el archivo. La tarea copia el archivo en la cola y en el registro."], "truncated": [say() + " The cache of node 7 che"]}
    rows += [(f"{d}:{k}", talk(ask, a)) for d, answers in bad.items() for k, a in enumerate(answers)]
    rows += [("short", talk(ask, "Yes.")), ("null", None), ("nulls", [None, (None, "user"), ("x", None)]), ("tool", [(ask, "user"), ("", "tool")]), ("nullq", [(None, "user"), (say(), "assistant")])]
    return rows, spark.createDataFrame([(*x, "c") for x in rows + rows[-12:]] + [(None, talk(ask, ""), "c")], "run_id string, conversations array<struct<content:string,role:string>>, defect string")


def test_phrases_are_counted_and_selected_by_one_aggregation(spark):
    lists = "kind int, keys array<bigint>, n_end array<int>, n_mid array<int>"
    scanned = spark.createDataFrame([(0, [1, 2, 3], [1, 0, 2], [0, 5, 1]), (0, [1, 4], [2, 1], [7, 0]), (1, None, None, None), (2, [4], None, None)], lists)
    wanted = spark.createDataFrame([([1, 9],), ([1, 3],), ([],), (None,)], "keys array<bigint>")
    assert sorted(map(tuple, truncation.phrase_stats(scanned, wanted).collect())) == [(1, 3, 7), (3, 2, 1)]


def test_cut_turns_take_little_memory(spark, monkeypatch):
    """Phrases are not joined, which would sort them all; texts are read in small batches; the session's own sizes come back."""
    rows, _ = cut_rows()
    df = spark.createDataFrame(rows, "run_id string, trace_source string, conversations array<struct<content:string,role:string>>")
    sizes, plans, run = set(), [], truncation.cut
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]

    def watched(x):
        sizes.update(int(spark.conf.get(n)) for n in names)
        if x.columns == ["k", "e", "m"]:
            plans.append(x._jdf.queryExecution().optimizedPlan().toString())
        return run(x)

    monkeypatch.setattr(truncation, "cut", watched)
    truncation.truncated_turns(df, "run_id", "conversations", "trace_source").count()
    assert sizes == {truncation.BATCH} and [spark.conf.get(n) for n in names] == before
    assert len(plans) == 1 and "Join" not in plans[0]


def test_broken_pairs(spark):
    rows, df = pair_table(spark)
    recs = pairs.records(df, "t", F.col("run_id"), "conversations", F.lit(None))
    got = pairs.broken_pairs(recs).collect()
    found = {(x.record_id, x.defect) for x in got}
    want = {(i, i.split(":")[0]) for i, _ in rows if ":" in i}
    assert want <= found and len(found - want) <= 2 and all(x.turn_index == 1 for x in got)
    assert len(got) == len(found)
    assert pairs.broken_pairs(recs.limit(0)).count() == 0


def test_answers_are_held_against_all_turns(spark, monkeypatch):
    whole = "Kappa lambda omicron sigma upsilon rhomboid zetetic quorum vellum parsec."
    rows = [("long", "a", [(whole, "tool")]), ("cut", "a", talk("What is it?", whole[:52])), *[(f"s{k}", "b", [(f"{k:03d} stops at wor", "system")]) for k in range(6)], *[(f"p{k}", "b", talk("Go on?", f"{k:03d} ends at wor")) for k in range(5)], ("null", None, talk("And?", "xyz begins a wo"))]
    df = spark.createDataFrame(rows, "run_id string, src string, conversations array<struct<content:string,role:string>>")
    seen, run = [], truncation.truncated_turns
    monkeypatch.setattr(truncation, "truncated_turns", lambda *a: seen.append(run(*a)) or seen[0])
    got = pairs.broken_pairs(pairs.records(df, "t", F.col("run_id"), "conversations", F.col("src"))).collect()
    why = {(x.id.split("\x00")[1], x.turn_index, x.source is None): x.reason for x in seen[0].where("NOT startswith(id, 'probe ')").collect()}
    assert why["cut", 1, False] == "longer_copy" and ("s0", 0, False) in why and ("null", 1, True) in why
    assert not {"long", "s0"} & {x.record_id for x in got}


def made_model(n=300):
    r = random.Random(12)
    nouns = ["cache", "queue", "socket", "marker", "ledger", "runner"]
    say = lambda: f"The {r.choice(nouns)} checks the {r.choice(nouns)} and writes line {r.randrange(900)} of the {r.choice(nouns)}."
    sample = [(("x", k), f"How does the {r.choice(nouns)} {k} work with the {r.choice(nouns)}?", " ".join(say() for _ in range(r.randrange(1, 5)))) for k in range(n + 100)]
    data = []
    for part in (sample[:n], sample[n:]):
        sound = pairs.sound_pairs(part, set())
        data.append(pairs.synthetic(sound, [(q, a, r.random() < 0.8) for q, a in pairs.cuts_of(sound)], seed=len(part)))
    return pairs.PairModel.train(data[0]), data[1]


def test_held_out_accuracy():
    model, held = made_model()
    hits = wrong = 0
    z = model.scores([pairs.Pair(q, a) for q, a, _, _ in held])
    for (_, _, evident, label), s in zip(held, z):
        s[1] += model.evidence * evident
        best = int(np.argmax(s)) if s.max() >= 0 else -1
        hits += best == label or (label == 1 and not evident and best == -1)  # without evidence a cut may look sound
        wrong += label < 0 <= best
    assert hits >= 0.85 * len(held) and wrong <= 0.02 * len(held)


def test_refusals_of_any_length_and_with_paths():
    model, _ = made_model()
    long = "I'm sorry, but I can't help with that. Please understand that I am not permitted to answer this, and that I must decline to go into this any further. " * 4
    refusals = ["I'm sorry, but I can't help with that and/or share details on it.", long, "Unfortunately, I am unable to assist with this request. Please see https://help.example/policy/page for more.", "word " * 3 + "I'm sorry, but I can't help with that."]
    z = model.scores([pairs.Pair("How does the cache 5 work with the queue?", a) for a in refusals])
    assert [int(x.argmax()) for x in z] == [2] * 4 and (z.max(axis=1) >= 0).all()
    # words never seen are no sign of a defect, nor is a sound answer that names what cannot be done
    sound = ["Zorbel vantri melgor, quinsal hevtor as well. Talvor mirren dalsel.", "The runner cannot write line 5 of the ledger while the marker checks the queue. The cache checks the socket and writes line 7 of the queue."]
    assert (model.scores([pairs.Pair("How does the cache 5 work with the queue?", a) for a in sound]) < 0).all()


def test_declining_is_never_overlooked():
    r = random.Random(2)
    some = [pairs._refuse(r, lang) for lang in ("en", "fr", "de", "es") for _ in range(400)] + ["I won’t do it", "Je refuse.", "Me rechazan", "sinto muito", "helaas kan ik niet", "It CANNOT be", "fine", ""]
    for s in some:
        assert pairs.declines(s, Counter(WORD.findall(s.lower()))) == (pairs._DECLINING.search(s) is not None), s


def test_slots_are_unique_and_cover_all_tokens():
    a, b = pairs.Pair("Why?", "one two three"), pairs.Pair(None, None)
    owner, slot = pairs.slots_of([b, a, b])
    assert set(owner.tolist()) == {0, 1, 2} and len(set(zip(owner.tolist(), slot.tolist()))) == len(slot)
    alone = pairs.slots_of([a])[1]
    assert alone.tolist() == slot[owner == 1].tolist()
    far = [pairs.slots_of([pairs.Pair("Why?", "word " * 200 + last)])[1] for last in ("alpha", "beta")]
    assert set(far[0].tolist()) != set(far[1].tolist())


# residue


CASES = [
    ("Notes on {{ model }}\n\nThe cache holds ${run_id} rows.", "placeholder"),
    ("Owner: <TEAM>, see [Project Name].", "placeholder"),
    ("Replace this paragraph with the summary.", "placeholder"),
    ("The prompt template uses one variable, written as `{{ task }}`, which the builder fills.", None),
    ("Die Vorlage `{{ name }}` wird vor jedem Aufruf durch Ilmar ersetzt.", None),
    ("Unfilled slots such as `[Your Name]` or `<DATE>` are rejected by the check.", None),
    ("Title\n\nLorem ipsum dolor sit amet velit. Culpa magna tempor nulla lacus porta risus erit.", "filler"),
    ("Sample text goes here. Text to be supplied later. Sample text goes here.", "filler"),
    ("The layout test still prints lorem ipsum words into /tmp/x.md; the real copy was checked in.", None),
    ("Home | Datasets | Models | Docs | Sign in\n404 - Page not found. Check the address and reload.\nRequest id a1b2c3d", "error_page"),
    ("RUN REPORT X\n\nACCESS DENIED. YOUR SESSION HAS EXPIRED.", "error_page"),
    ('{"error": {"code": 503, "message": "Service unavailable.", "request_id": "a1"}}', "error_page"),
    ("Your browser has JavaScript disabled, so the chart cannot be shown. Contact support", "script_notice"),
    ("Aktivieren Sie JavaScript, um fortzufahren.", "script_notice"),
    ("The dashboard needs JavaScript, so the agent fetched the raw rows through the API and never opened the page.", None),
    ("Twice the gateway answered 502 Bad Gateway, and the worker simply retried. The run then read all of its rows and ended well.", None),
    ("", None),
    (None, None),
    ("plain words " * 20_000, None),
]
LONG = "502 Bad Gateway. " + "The upstream server sent an invalid response. Please try again in a minute. " * 20
UNSEEN = [
    ("Hmm. We're having trouble finding that site.", "error_page"),
    ("Proxy failure: the origin returned an invalid reply.", "error_page"),
    ("Dear #FIRSTNAME#, welcome to ~~company~~", "placeholder"),
    ("This site needs ECMAScript. Allow scripting in settings.", "script_notice"),
    ("Handover notes\nYou need to enable Java Script to see this chart.", "script_notice"),
    ("The requested document was not found on this host.", "error_page"),
    ("We could not find the notebook that you were looking for.", "error_page"),
    (LONG, "error_page"),
    (LONG + "The worker read every row of the table and wrote the report to disk. " * 20, None),
]


def test_kinds_of_residue(spark):
    cases = CASES + UNSEEN
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {x.doc_id: x.residue_kind for x in residue.residue(df).collect()}
    wrong = [(t[:80] if t else t, want, got.get(k)) for k, (t, want) in enumerate(cases) if got.get(k) != want]
    assert not wrong


def test_residue_spreads_to_copies(spark):
    r = random.Random(3)
    slot = text(r, 150) + " Owner: {{ team }} and {{ contact }}."
    bare = slot.replace("{{ ", "").replace(" }}", "")
    filled = slot.replace("{{ team }}", "Ana").replace("{{ contact }}", "Ben")
    filler = " ".join(["Sample text goes here."] * 30)
    rows = [(1, slot), (2, "The pages were checked. Access denied."), (3, bare), (4, filled), (5, text(r, 150)), (6, filler), (7, filler.upper()), (8, None), (9, ""), (10, "???"), (11, "Access denied for this preview.\nAccess denied.\nGo back."), (12, "Access was denied for this preview. Access denied."), (13, "\ud83d\ude00 " * 5 + "x" * 100_000)]
    df = spark.createDataFrame(rows + rows[:2] + [(None, slot)], "doc_id bigint, text string").withColumn("label", F.lit("clash")).withColumn("id", F.lit(1))
    found = residue.residue(df).collect()
    got = {x.doc_id: (x.residue_kind, x.how) for x in found}
    assert len(got) == len(found)
    assert got[1] == ("placeholder", "rule") and got[3] == ("placeholder", "copy") and got[6] == got[7] == ("filler", "seed")
    assert not {4, 5, 8, 9, 10, 13} & set(got)
    assert residue.residue(df.limit(0)).count() == 0


def test_labels_spread_over_sentences_of_no_seed(spark):
    # the second sentence is unlike the seed, but like one that is like it
    seeds = [("error_page", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("furniture", "go back")]
    a = "alpha beta gamma delta epsilon zeta eta one two three"
    b = "alpha beta gamma delta one two three zeta four five"
    df = spark.createDataFrame([(1, f"Title. {a}. {b}."), (2, f"Title. {b}."), (3, f"Title. {a}. Some other words that were never seen before, and more of them.")], "doc_id bigint, text string")
    got = {x.doc_id: x.how for x in residue.residue(df, seeds=seeds).collect()}
    assert got == {1: "near_copy"}


def test_labels_spread_to_texts_of_no_seed(spark):
    # each sentence is like the one before it only; the texts of all but the first have no trusted sentence
    seeds = [("error_page", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("furniture", "go back")]
    a = "alpha beta gamma delta epsilon zeta eta one two three"
    b = "alpha beta gamma delta one two three zeta four five"
    c = "alpha beta one two three zeta four five six seven"
    rows = [(1, f"Title. {a}."), (2, f"Title. {b}."), (3, f"Title. {a}. Some other words that were never seen before, and more of them."), (4, f"{c}! Go back."), (5, "Title. one two three four five six eight nine ten eleven."), (6, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (100_000, 1):
        got = [(x.doc_id, x.residue_kind, x.how) for x in residue.residue(df, seeds=seeds, every=True, most=most).collect()]
        assert sorted(got) == [(k, "error_page", "near_copy") for k in (1, 2, 4)]
    assert residue.residue(df.limit(0), every=True).count() == 0


def test_trusted_sentences_behind_long_ones(spark):
    # nothing stands between the sentences; the second one begins after more than ten words
    rows = [(1, "The requested URL was not found on this server and may have moved We could not find the page you are looking for"), (2, "an unexpected condition was met while loading this page this page was deleted or never existed the link you followed may be broken")]
    seeds = residue.Seeds([("error_page", "the requested url was not found on this server and may have moved")] + residue.SEEDS)
    found = residue._sentences([t for _, t in rows], seeds)
    assert [sum(x[0] == k and x[4] >= 0 for x in found) for k in (0, 1)] == [2, 3]


def test_index_leaves_no_pair_out():
    # a word that occurs three times weighs more in a SimHash than three words
    seeds = residue.Seeds([("error_page", f"{x} beta gamma delta epsilon zeta eta theta iota kappa") for x in ("alpha", "omega")])
    tail = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    each = [np.array([residue._tokens[t] for t in ["beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", x, x, x]], np.uint64) for x in tail]
    sizes = np.full(len(each), 10)
    assert (seeds.nearest(np.concatenate(each), np.cumsum(sizes) - sizes, sizes)[0] == 0).all()
    r = random.Random(41)
    for _ in range(30):
        v = r.choice([5, 12, 40])
        own, other = ([np.array([r.randrange(v) for _ in range(r.randint(1, 14))], np.uint64) for _ in range(50)] for _ in range(2))
        groups, but = np.array([r.choice([0, 3, 4]) for _ in own]), np.array([r.choice([-1, 0, 1, 3, 9]) for _ in other])
        index, sizes = residue.Index(own, groups), np.array([len(x) for x in other])
        index.PAIRS = r.choice([5, 300, 10**6])
        i, k, share = index.pairs(np.concatenate(other), np.cumsum(sizes) - sizes, sizes, but)
        brute = {(x, y): residue.alike(Counter(p.tolist()), Counter(q.tolist())) for x, p in enumerate(other) for y, q in enumerate(own) if groups[y] != but[x]}
        assert dict(zip(zip(i.tolist(), k.tolist()), share.tolist())) == {p: x for p, x in brute.items() if x >= residue.ALIKE}


def test_simhash_tables_find_edited_sentences(spark):
    r = random.Random(31)
    rows, of = [], {}
    for k in range(40):
        base = text(r, 14).split()
        for v in range(6):
            w = list(base)
            if v:
                w[r.randrange(14)] = f"other{r.randrange(10**6)}"
            of[len(rows)] = k
            rows.append((len(rows), " ".join(w)))
    links = residue._near(spark.createDataFrame(rows, "sentence bigint, words string"), 16).select("a", "b").collect()
    brute = {(x, y) for x, a in rows for y, b in rows[x + 1 :] if residue.alike(Counter(a.split()), Counter(b.split())) >= residue.ALIKE}
    assert len({(x.a, x.b) for x in links} & brute) >= 0.9 * len(brute) and len(links) <= len(brute)
    assert all(of[x.a] == of[x.b] for x in links)
    groups = components.components(spark.createDataFrame([(x.a, x.b) for x in links], "a bigint, b bigint"), "a", "b").collect()
    assert len(groups) >= 0.98 * len(rows)
    per = {}
    for x in groups:
        per.setdefault(of[x.id], set()).add(x.component)
    assert sum(len(v) == 1 for v in per.values()) >= 0.95 * 40
