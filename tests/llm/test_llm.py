"""The training-data operators against brute force, round trips and hand-made cases."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import graph, lookalike, neardup, overlap, packing, pairs, quota, shingles, subjects, tokens

FORM = lookalike.ConsistentForm.default()
WORD = re.compile(r"[^\W_]+")


def words(t):
    return frozenset(WORD.findall(FORM.apply(t).lower()))


def linked(a, b):
    return 10 * len(a & b) >= 6 * len(a | b)


def corpus(n=120, seed=0):
    """Texts with edited copies, exact copies and shared boiler-plate."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for g in range(n // 4):
        base = rng.sample(vocabulary, rng.randint(12, 40))
        for c in range(4):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 2)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rng.shuffle(t)
            out[f"id-{g}-{c}"] = " ".join(t)
    return out


def classes_by_force(texts):
    ids = sorted(texts)
    w = {i: words(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(w[a], w[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def table(spark, texts, extra=()):
    rows = [(i, t, "x", 1) for i, t in texts.items()] + list(extra)
    return spark.createDataFrame(rows, "id string, text string, form string, rid int")  # columns that clash with inner names


# ---- look-alikes


@pytest.mark.parametrize(("a", "b"), [("ｈｉ．", "hi."), ("pаyрal", "paypal"), ("a​b­c", "abc"), ("x  y", "x y"), ("é", "é"), ("е́", "é"), ("ﬁn", "fin"), ("\U0001d41a\U0001d5c7", "an"), ("ⅼ", "l"), ("a⁠﻿", "a"), ("Å", "Å"), (" a  b\n", "a b")])
def test_equal_looks(a, b):
    assert FORM.apply(a) == FORM.apply(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("resume", "résumé"), ("1", "l"), ("0", "O"), ("ß", "ss"), ("a.", "a!"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("\U0001f44d\U0001f3fd", "\U0001f44d"), ("x²", "x2"), ("“a”", '"a"')])
def test_different_looks(a, b):
    assert FORM.apply(a) != FORM.apply(b)


def test_form_is_idempotent_and_total():
    rng = random.Random(1)
    alphabet = [c for cls in lookalike.relation() for s in cls for c in s] + list("abc ́‍\U0001f469")
    for _ in range(500):
        t = "".join(rng.choices(alphabet, k=20))
        assert FORM.apply(FORM.apply(t)) == FORM.apply(t)
    assert FORM.apply("​") == "" and FORM.apply("") == "" and FORM.apply(None) is None


@pytest.mark.parametrize(("a", "b"), [("\uff76\uff9e", "\u30ac"), ("\u1112\u1161\u11ab", "\ud55c"), ("a\u0323\u0302", "a\u0302\u0323"), ("x\ufe05y\U000e0101", "xy")])
def test_canonical_forms_look_equal(a, b):
    assert FORM.apply(a) == FORM.apply(b)


def test_equality_does_not_depend_on_the_representatives():
    """Other problems use the form without counts; it must tell the same texts apart as a fitted one."""
    rng = random.Random(4)
    classes = [c for c in lookalike.relation() if "" not in c and not any(unicodedata.combining(s[0]) for s in c)]
    for _ in range(6):
        fitted = lookalike.ConsistentForm(lookalike.representatives({s: rng.randrange(9) for c in classes for s in c}))
        for _ in range(300):
            picks = rng.choices(classes, k=6)
            a, b = ("".join(rng.choice(c) for c in picks) for _ in range(2))
            assert FORM.apply(a) == FORM.apply(b) and fitted.apply(a) == fitted.apply(b), (a, b)
            c = "".join(rng.choice(c) for c in rng.choices(classes, k=6))
            assert (FORM.apply(a) == FORM.apply(c)) == (fitted.apply(a) == fitted.apply(c))


def test_representative_is_the_most_frequent():
    rep = lookalike.representatives({"a": 1, "а": 5})
    assert rep["a"] == "а" and lookalike.representatives({"a": 5, "а": 1})["а"] == "a"


def test_lookalike_pairs(spark):
    df = spark.createDataFrame([("1", "abc", 0), ("2", "аbc", 0), ("3", "abc", 0), ("4", "Abc", 0), ("5", None, 0), ("6", "​", 0), ("7", "", 0)], "id string, text string, form_key int")
    form = lookalike.ConsistentForm.fit(df)
    got = {tuple(r) for r in lookalike.lookalike_pairs(lookalike.lookalike_variants(df, form)).collect()}
    assert got == {("1", "2"), ("2", "3")}
    many = spark.createDataFrame([(f"i{i:02}", "a" * (i // 3) + "\u200b" + "a" * (20 - i // 3)) for i in range(30)], "id string, text string")
    many = lookalike.lookalike_variants(many, lookalike.ConsistentForm.fit(many))
    assert lookalike.lookalike_pairs(many, salt_rows=3).distinct().count() == lookalike.lookalike_pairs(many, salt_rows=3).count() == 30 * 29 // 2 - 10 * 3
    assert lookalike.lookalike_pairs(lookalike.lookalike_variants(df.limit(0), lookalike.ConsistentForm.fit(df.limit(0)))).count() == 0


# ---- similar records


@pytest.mark.parametrize("bucket", [48, 2])
def test_classes_match_brute_force(spark, bucket):
    """With a bucket of two nearly all go through leaders and blocks."""
    texts = corpus()
    copy = {"copy": texts["id-1-1"].upper()}
    extra = [("n1", None, "x", 1), ("n2", " \u200b ", "x", 1), ("n3", "!!!", "x", 1), ("copy", copy["copy"], "x", 1), ("copy", copy["copy"], "x", 2), (None, "no id", "x", 1)]
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicate_classes(table(spark, texts, extra), bucket=bucket).collect()}
    assert got == classes_by_force(texts | copy)


def test_large_buckets_lose_no_link(spark):
    texts = {f"h{i:03}": "one two three four five six seven eight nine ten " + ("extra%d" % i) for i in range(150)} | corpus(40, 3)
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicate_classes(table(spark, texts), bucket=8).collect()}
    assert got == classes_by_force(texts)


def test_class_pairs_are_all_pairs(spark):
    df = spark.createDataFrame([(f"i{i:03}", "c", 60) for i in range(60)] + [("z", "z", 1)], "id string, class_id string, class_size long")
    got = neardup.class_pairs(df, salt_rows=7).collect()
    assert len(got) == 60 * 59 // 2 == len({tuple(r) for r in got}) and all(r["id_a"] < r["id_b"] for r in got)


def test_no_records(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert neardup.near_duplicate_classes(empty).count() == 0 and overlap.split_overlaps(empty, empty).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_overlaps_match_brute_force(spark):
    texts = corpus(160, 5)
    ev, tr = {k: v for i, (k, v) in enumerate(texts.items()) if i % 2}, {k: v for i, (k, v) in enumerate(texts.items()) if not i % 2}
    got = {(r["item_id"], r["hit_id"]) for r in overlap.split_overlaps(table(spark, ev, [("n", None, "x", 1)]), table(spark, tr, [("copy", next(iter(ev.values())), "x", 1)])).collect()}
    tr = tr | {"copy": next(iter(ev.values()))}
    assert got == {(a, b) for a in ev for b in tr if linked(words(ev[a]), words(tr[b]))}


def test_balls_meet_within_their_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, (1, 8), dtype=np.uint64)
    for change in range(4):
        b = a.copy()
        b[0, :change] += np.uint64(1)
        shared = set(shingles.ball_keys(a, 1, 8, 1)[0]) & set(shingles.ball_keys(b, 1, 8, 1)[0])
        assert bool(shared) == (change <= 1)


# ---- sampling


def test_quotas_and_trim(spark):
    rows = [(f"i{i}", "Example " if i % 10 else "rare", "en" if i % 3 else None, None) for i in range(1000)] + [("i1", "example", "EN", None), (None, "rare", "en", None)]
    kb = spark.createDataFrame(rows, "id string, kind string, lang string, source string").withColumn("target_id", F.lit(99))
    t = spark.createDataFrame([(1, "k", 0.1, "example", None, None, 0.8, 5), (2, "k", 0.1, "RARE", None, None, 0.2, 200), (3, "l", 0.1, None, "en", None, 0.5, 1), (4, "l", 0.1, None, None, "none", 0.0, 0)], "target_id long, plan_key string, sample_share double, kind string, lang string, source string, target_share double, min_rows int")
    sample, plan = quota.sample(kb, t)
    got = {r["target_id"]: (r["available"], r["quota"], r["is_met"]) for r in plan.collect()}
    assert got == {1: (900, 80, True), 2: (100, 100, False), 3: (666, 50, True), 4: (0, 0, True)}
    assert {r["target_id"]: r["count"] for r in sample.groupBy("target_id").count().collect()} == {1: 80, 2: 100, 3: 50}
    ids = {r["id"] for r in sample.filter("target_id = 1").collect()}
    assert len(ids) == 80 and {r["id"] for r in quota.sample(kb.repartition(5), t)[0].filter("target_id = 1").collect()} == ids
    empty, unmet = quota.sample(kb.limit(0), t)
    assert empty.count() == 0 and {r["target_id"] for r in unmet.filter("not is_met").collect()} == {1, 2, 3}


def test_small_reservoirs_are_drawn_again(spark, monkeypatch):
    """Without slack partitions drop ids that the cut needs; the state shows it and the pass is made again."""
    kb = spark.range(3000).selectExpr("cast(id as string) as id", "'x' as kind", "'en' as lang", "'s' as source")
    t = spark.createDataFrame([(1, "k", 0.5, "x", None, None, 0.9, 1)], "target_id long, plan_key string, sample_share double, kind string, lang string, source string, target_share double, min_rows int")
    real, seen = quota.reservoirs, []

    def tighter(*a, slack, **k):
        seen.append(slack)
        return real(*a, slack=-0.5 if len(seen) == 1 else slack, **k)

    whole = {r["id"] for r in quota.sample(kb, t)[0].collect()}
    monkeypatch.setattr(quota, "reservoirs", tighter)
    assert {r["id"] for r in quota.sample(kb, t)[0].collect()} == whole and len(whole) == 1350 and len(seen) == 2
    state = real(kb, t)
    assert state.filter("id is not null").count() < 3000


# ---- answers


def judged(final, item="The neighbours of Kelton are kind and they helped us for days, with a grin."):
    return pairs.judge(final, item, lookalike._rewriter(FORM.pairs))[0]


@pytest.mark.parametrize(
    ("final", "want"),
    [
        (None, ["empty"]), ("", ["empty"]), ("```json\n```", ["empty"]), ("null", ["empty"]), ("<think>\n</think>\n", ["empty"]), ("{}", ["empty"]), ('{"reasoning": "N/A", "hate": true}', ["empty"]), ('{"reasoning": "​", "hate": true}', ["empty"]),
        ("<think>The text is", ["truncated"]), ('{"reasoning": "The text is kind.", "hate": fal', ["truncated"]), ('```json\n{"reasoning": "The text is', ["truncated"]),
        ("I can't assist with this request.", ["refusal"]), ('{"reasoning": "Diese Anfrage muss ich ablehnen.", "hate": false}', ["refusal"]), ("As a language model, I don't judge such a text.", ["refusal"]), ("Lo siento, pero no puedo ayudar con eso.", ["refusal", "language"]),
        ('{"reasoning": "The neighbours of Kelton are kind and they helped us for days", "hate": false}', ["copy"]), ("the neighbours of kelton are kind and they helped us for days, with a grin.", ["copy"]),
        ('{"reasoning": "Der Text beschreibt die Nachbarn und lobt eher eine Gruppe.", "hate": false}', ["language"]), ('{"reasoning": "Le texte décrit la ville et ne rabaisse pas un groupe.", "hate": false}', ["language"]),
        ('{"reasoning": "The author says sorry but cannot help with that; it praises a group.", "hate": false}', []), ("{'reasoning': 'The text praises a group.', 'hate': False, 'legal': []}", []), ('<think>x {maybe}</think>\n{"reasoning": "The text is kind.", "hate": false}', []), ('{"reasoning": "The text is kind.", "hate": true, "hate_type": ["spam"]}', []),
    ],
)
def test_defects(final, want):
    assert judged(final) == want


@pytest.mark.parametrize("said", ["Текст хвалит соседей и никого не унижает.", "该文本赞扬了邻居，没有贬低任何群体。", "النص يمدح الجيران ولا يهين أحدا.", "Tekst chwali sąsiadów oraz nie poniża żadnej grupy, która jest w nim.", "Bu metin komşuları övüyor ve hiçbir grubu küçümsemiyor, çok nazik bir dil ile."])
def test_other_scripts_and_languages(said):
    assert judged('{"reasoning": "%s", "hate": false}' % said) == ["language"]
    assert "language" not in judged('{"reasoning": "%s", "hate": false}' % said, said + " " + said)


@pytest.mark.parametrize("said", ["Mi dispiace, ma non posso aiutare.", "Não posso avaliar este texto.", "Ik kan dit verzoek niet beantwoorden.", "Nie mogę ocenić tego tekstu.", "Üzgünüm, bu isteğe yanıt veremem.", "Извините, я не могу это оценить.", "抱歉，我无法评估该文本。", "عذرا، لا أستطيع تقييم هذا النص."])
def test_refusals_in_every_language(said):
    assert "refusal" in judged(said)


def test_open_ends_are_judged_by_the_corpus(spark):
    full = '{{"reasoning": "This line number {} praises a whole group.", "hate": false}}'
    runs = [(i, "it", [full.format(i)]) for i in range(30)] + [(100, "it", ['{"reasoning": "This line praises a whole group", "hate": false}']), (101, "it", ['{"reasoning": "This line praises because the", "hate": false}']), (102, "gone", ["", None]), (103, "it", None), (None, "it", ["x"]), (104, None, ["I cannot help with this."])]
    df = spark.createDataFrame(runs, "run_id long, item_id string, raw_outputs array<string>").withColumn("logged_at", F.lit(None).cast("timestamp")).withColumn("text", F.lit(1))
    items = spark.createDataFrame([("it", "The people next door are kind to us and to them."), ("it", None)], "id string, text string").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    got = {r["run_id"]: r["defect"] for r in pairs.defective_answers(df, items).collect()}
    assert got == {101: "truncated", 102: "empty", 103: "empty", 104: "refusal"}
    assert pairs.defective_answers(df.limit(0), items.limit(0)).count() == 0


def test_answers_without_a_sentence(spark):
    df = spark.createDataFrame([(1, "it", ["I can't"]), (2, "it", None)], "run_id long, item_id string, raw_outputs array<string>").withColumn("logged_at", F.lit(None).cast("timestamp"))
    items = spark.createDataFrame([], "id string, text string, ingested_at timestamp")
    assert {r["run_id"] for r in pairs.defective_answers(df, items).collect()} == {1, 2}


def test_copies_that_break_off_are_truncated_too(spark):
    said = "The people next door are kind to us and to"
    df = spark.createDataFrame([(1, "it", [f'{{"reasoning": "{said}", "hate": false}}']), (2, "it", [f'{{"reasoning": "{said} them.", "hate": false}}'])], "run_id long, item_id string, raw_outputs array<string>").withColumn("logged_at", F.lit(None).cast("timestamp"))
    items = spark.createDataFrame([("it", said + " them.")], "id string, text string").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    got = {r["run_id"]: (r["defect"], r["defects"]) for r in pairs.defective_answers(df, items).collect()}
    assert got == {1: ("copy", ["copy", "truncated"]), 2: ("copy", ["copy"])}


@pytest.mark.parametrize("size", [1, 10])
def test_open_ends_do_not_depend_on_the_size_of_the_table(spark, size):
    often = '{"reasoning": "It is so calm, so kind, so mild, so warm, so fair, so good, so neat and so." , "hate": false}'
    runs = [(i, "it", [often]) for i in range(25 * size)] + [(-1, "it", ['{"reasoning": "The author mentions the appreciation, so", "hate": false}']), (-2, "it", ['{"reasoning": "It is so neat and so", "hate": false}']), (-3, "it", ['{"reasoning": "It is warm and the whole line is so mild", "hate": false}'])]
    df = spark.createDataFrame(runs, "run_id long, item_id string, raw_outputs array<string>").withColumn("logged_at", F.lit(None).cast("timestamp"))
    items = spark.createDataFrame([("it", "The people next door are kind to us and to them.")], "id string, text string").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    assert {r["run_id"]: r["defect"] for r in pairs.defective_answers(df, items).collect()} == {-1: "truncated", -3: "truncated"}


# ---- tokens and packing


def test_tokens_round_trip(spark):
    texts = ["", None, "hello world", "<|endoftext|> 한국어 \U0001f469‍\U0001f4bb", "a" * 3000, "word  two\n\n three 12 " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    ranks = tokens.rank_bytes()
    assert got[0] == [] and got[1] == []
    for i, t in enumerate(texts):
        if t:
            assert tokens.decode(got[i], ranks) == t and got[i] == tokens.encoding(ranks).encode_ordinary(t)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}


def test_packing_invariants(spark):
    rng = random.Random(0)
    sizes = [rng.randint(1, 300) for _ in range(600)] + [1500, 0, -3]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(1000, None), (5, sizes[5])], "item long, size long").withColumn("capacity", F.lit("clash"))
    limits = spark.createDataFrame([("s", 400), ("l", 1000), ("bad", 0), (None, 5)], "limit_key string, capacity long")
    got = packing.pack(items.select("item", "size"), limits, windows=20).collect()
    for key, cap in (("s", 400), ("l", 1000)):
        mine = [r for r in got if r["limit_key"] == key]
        fill, total = {}, {}
        for r in mine:
            fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["size"]
            total[r["item"]] = total.get(r["item"], 0) + r["size"]
        assert max(fill.values()) <= cap and total == {i: max(s, 0) for i, s in enumerate(sizes)} | {1000: 0}
        assert sum(sizes[:601]) / (cap * len(fill)) > 0.93
        assert all(len([r for r in mine if r["item"] == i]) == max(1, -(-s // cap)) for i, s in enumerate(sizes))
    assert packing.pack(items.select("item", "size").limit(0), limits).count() == 0


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 512, 800), np.minimum(rng.lognormal(4.5, 1, 900).astype(int) + 1, 512), np.full(500, 200), np.array([512, 1])):
        window = packing.pack_group(sizes, 512)
        fill = np.bincount(window, weights=sizes)
        assert fill.max() <= 512 and window.min() == 0 and (fill > 0).all()
        least = max(-(-sizes.sum() // 512), (sizes > 256).sum())
        assert len(fill) <= (250 if sizes[0] == sizes[-1] == 200 else 1.03 * least + 1)


def test_groups_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    items = spark.range(1000).selectExpr("id as item", "cast(id % 2 as long) as size")
    got = packing.pack(items, spark.createDataFrame([("w", 100_000)], "limit_key string, capacity long"), rounds=1)
    by = got.groupBy("window_id").count().collect()
    assert sum(r["count"] for r in by) == 1000 and len(by) == 20


# ---- subjects


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(0)
    lex = {s: [w for w in v.split()][:6] + [f"{s}word{i}" for i in range(12)] for s, v in subjects.SEEDS.items()}
    docs, truth, labels = [], {}, []
    for d in range(400):
        s, other = rng.sample(sorted(lex), 2)
        two = d % 4 == 0
        lines = [f"The {rng.choice(lex[s])} and the {rng.choice(lex[s])} met {rng.choice(lex[s])} today." for _ in range(4)] + ([f"A {rng.choice(lex[other])} saw {rng.choice(lex[other])} again!" for _ in range(3)] if two else []) + ["Thanks, noted."]
        truth[d] = {s, other} if two else {s}
        docs.append((d, " ".join(lines), "board", "thr-0" if d % 3 == 0 else None))
        if d < 60:
            labels.append((d, s if d % 20 else other))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "12 34 !!!", None, None), (1003, "Thanks, noted.", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, thread_key string").withColumn("body", F.lit(1))
    shares = subjects.subject_shares(df, spark.createDataFrame([*labels, (5, "unknown"), (9999, "law")], "doc_id long, subject string"), list(lex)).filter("share >= 0.25")
    got = {}
    for r in shares.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [d for d in truth if d >= 60]
    assert sum(got.get(d) == truth[d] for d in held) >= 0.95 * len(held) and not {1000, 1001, 1002} & set(got)
    assert subjects.subject_shares(df.limit(0), spark.createDataFrame([], "doc_id long, subject string"), list(lex)).count() == 0


def test_split_into_sentences():
    texts = ["One two. Two, two!) \u201cthree\u201d? @name four x1 1y", "", "a.b c\ue00ad", "...", "ärger ÉTÉ"]
    words, sizes, per = subjects.split_words([t.lower() for t in texts])
    key = lambda *w: set(subjects.word_keys(list(w)).tolist())
    got = [set(s.tolist()) for s in np.split(words, np.cumsum(sizes)[:-1])]
    assert got == [key("one", "two"), key("two"), key("three"), key("four", "x"), key("a", "b", "c"), key("d"), key("ärger", "été")]
    assert per.tolist() == [4, 0, 2, 0, 1]


def test_addresses_vote():
    seeds = {"law": 0, "court": 0, "sport": 1}
    vote = lambda t: subjects.address_vote(t, seeds, 2)
    assert vote("see https://x.test/Court/1 and #sport or www.law.test") == 0
    assert vote("mail a@sport.test") == 1 and vote("law and court") == 2 and vote("#law #sport") == 2 and vote("hi @sport") == 2


def test_latent_model_learns_who_errs():
    rng = np.random.default_rng(0)
    n, truth = 4, rng.integers(0, 4, 4000)
    votes = np.stack([np.where(rng.random(4000) < p, truth, rng.integers(0, 4, 4000)) for p in (0.95, 0.9, 0.2)], axis=1)
    pat, count = np.unique(votes, axis=0, return_counts=True)
    hit, *_ = subjects.latent_accuracies(pat, count.astype(float), n)
    assert hit[0] > 0.9 > hit[2] + 0.3
