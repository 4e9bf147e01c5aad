"""Hand-made cases of the core operators."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.functions import stats, text
from evalweave.operators import analysis, audit, kb, labels, metrics, parse, prompt, retrieve, run, sampling, study, vote
from evalweave.plans import audits, retrieval
from evalweave.sources import config, jsonl

GOOD = '{"reasoning": "a } b", "hate": true, "target_group": ["race"], "hate_type": [], "severity": "low", "legal": []}'
RUNS = "run_id long, item_id string, arm string, run_idx int, reasoning string, hate boolean, target_group array<string>, hate_type array<string>, severity string, legal array<string>, parse_failure boolean"


WRAPS = ["{}", "```json\n{}\n```", "Sure: {} Bye", "<think>{{x}}</think>{}", "{} }}", 'He said "{{" and {}', "{} {{}}"]


def read(spark, *answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "k int, a string")
    return [r for r in parse.parse_answers(df, "a").orderBy("k").collect()]


def test_answers_in_any_wrapping(spark):
    for r in read(spark, *[w.format(GOOD) for w in WRAPS[:5] + WRAPS[6:]]):
        assert (r["reasoning"], r["hate"], r["target_group"], r["severity"], r["normalisations"], r["error"]) == ("a } b", True, ["race"], "low", 0, None)


def test_whole_objects():
    assert parse.whole_objects(GOOD + " }") == GOOD and parse.whole_objects("no object") == "no object" and parse.whole_objects('{"a": ') == '{"a": '
    assert parse.whole_objects('{"a": "}') == '{"a": "}' and parse.whole_objects('{"a": {"b": "\\"}"}} {') == '{"a": {"b": "\\"}"}}'


def test_answers_without_object(spark):
    assert all(r["error"] and r["hate"] is None and r["normalisations"] == 0 for r in read(spark, "no object", None, "", 'x {"a": ', "[1]", '"text"'))


def test_repairs_are_counted(spark):
    bent = '{"Reasoning": "r", "is_hate": "yes", "target_group": "Sexual Orientation", "hate_type": null, "severity": "none", "legals": ["Insult-Defamation"]}'
    both = '{"reasoning": "r", "hate": false, "hateful": true}'
    r, plain, twice, words = read(spark, bent, '{"reasoning": "r", "hate": false}', both, '{"reasoning": "r", "hate": " TRUE ", "severity": "None"}')
    assert (r["reasoning"], r["hate"], r["target_group"], r["hate_type"], r["severity"], r["legal"]) == ("r", True, ["sexual_orientation"], [], None, ["insult_defamation"])
    assert r["normalisations"] == 8 and plain["normalisations"] == 0 and plain["error"] is None
    assert twice["hate"] is True and twice["normalisations"] == 1 and (words["hate"], words["normalisations"]) == (True, 2)


@pytest.mark.parametrize(("extra", "error"), [("", None), (', "x": 1', "unexpected"), (', "hate_type": ["spam"]', "unknown hate_type: spam"), (', "hate": "maybe"', "hate is no truth"), (', "legal": 3', "legal is no list"), (', "severity": 2', "unknown severity"), (', "target_group": [1]', "unknown target_group"), (', "severity": "huge"', "unknown severity: huge"), (', "reasoning": 1', "no text")])
def test_violations(spark, extra, error):
    (r,) = read(spark, '{"reasoning": "r", "hate": true' + extra + "}")
    assert (r["error"] is None) if error is None else error in r["error"]


def test_gate_clears_labels_but_not_legal(spark):
    (r,) = read(spark, '{"reasoning": "r", "hate": false, "target_group": ["race"], "legal": ["propaganda"]}')
    assert r["hate"] is False and r["target_group"] == [] and r["legal"] == ["propaganda"] and r["gate_normalised"] is True


def test_parse_runs(spark):
    df = spark.createDataFrame([(1, ["bad", GOOD, "late"]), (2, [None, ""]), (3, [GOOD])], "run_id long, raw_outputs array<string>")
    got = {r["run_id"]: (r["hate"], r["repairs"], r["parse_failure"]) for r in parse.parse_runs(df).collect()}
    assert got == {1: (True, 1, False), 2: (None, 1, True), 3: (True, 0, False)}


def test_vote(spark):
    rows = [
        (1, "a", "x", 0, "no", False, [], [], None, [], False), (2, "a", "x", 1, "yes", True, ["race", "race"], ["irony"], "low", ["propaganda"], False), (3, "a", "x", 2, "yes2", True, ["race"], [], "high", ["propaganda"], False),
        (4, "tie", "x", 0, "n", False, None, [], None, [], False), (5, "tie", "x", 1, "y", True, ["race"], [], "low", ["propaganda"], False),
        (6, "failed", "x", 0, None, None, None, None, None, None, True),
    ]
    got = {r["item_id"]: r for r in vote.vote(spark.createDataFrame(rows, RUNS)).collect()}
    a, tie, failed = got["a"], got["tie"], got["failed"]
    assert (a["hate"], a["target_group"], a["hate_type"], a["severity"], a["legal"], a["reasoning"]) == (True, ["race"], [], "low", ["propaganda"], "yes")
    assert a["dropped"] == ["hate_type"] and round(a["agreement_hate"], 3) == 0.667
    assert (tie["hate"], tie["uncertain"], tie["target_group"], tie["reasoning"]) == (False, True, [], "n")
    assert failed["hate"] is None and failed["target_group"] is None and failed["n_valid"] == 0 and failed["n_runs"] == 1


def test_mask_keeps_null_apart_from_empty(spark):
    items = spark.createDataFrame([("n", None, None), ("e", True, []), ("x", True, ["race"]), ("f", False, ["race"])], "id string, gate boolean, target_groups array<string>").withColumn("hate_types", F.lit(None).cast("array<string>")).withColumn("legal", F.lit(None).cast("array<string>"))
    voted = spark.createDataFrame([(i, "a", 1, ["race"], [], []) for i in "nexf"], "item_id string, arm string, n_valid int, target_group array<string>, hate_type array<string>, legal array<string>")
    assert {r["item_id"] for r in metrics.label_pairs(voted, items).collect()} == {"e", "x"}


def test_single_class_has_no_macro(spark):
    p = spark.createDataFrame([("i", "a", "s", True, True, False, 1.0, "strict")], "item_id string, arm string, source string, truth boolean, pred boolean, uncertain boolean, confidence double, mapping string")
    r = metrics.score_gate(p).first()
    assert r["macro_f1"] is None and r["f1_hate"] == 1.0


def test_support_at_the_border(spark):
    rows = [(f"i{i}", "a", "hate_type", ["irony"] if i < 10 else ["explicit"], ["irony"]) for i in range(19)]
    got = {r["label"]: r["averaged"] for r in metrics.per_label(spark.createDataFrame(rows, "item_id string, arm string, dimension string, gold array<string>, pred array<string>")).collect()}
    assert got == {"irony": True, "explicit": False}


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([(["spam"],)], "x array<string>")
    with pytest.raises(Exception, match="unknown label"):
        df.select(labels.multi_hot(F.col("x"), "hate_type")).collect()


def test_first_seen_class_wins_ties(spark):
    df = spark.createDataFrame([('{"votes": ["b", "a", "a", "b"]}',), ('{"votes": []}',), ("{torn",), (None,)], "raw string")
    assert [r[0] for r in df.select(labels.original_class("raw")).collect()] == ["b", None, None, None]


def test_exact_p():
    assert stats.exact_p(0, 0) == 1.0 and round(stats.exact_p(1, 9), 5) == 0.02148 and 0 < stats.exact_p(40_000, 41_000) < 0.001


def test_alpha_is_undefined_on_perfect_agreement(spark):
    u = spark.createDataFrame([("a", "d", "u1", 1), ("a", "d", "u1", 1), ("a", "d", "u2", 1), ("a", "d", "u2", 1)], "arm string, dimension string, unit string, value int")
    assert analysis.alpha(u).first()["alpha"] is None
    v = spark.createDataFrame([("a", "d", "u1", 0), ("a", "d", "u1", 0), ("a", "d", "u2", 1), ("a", "d", "u2", 1)], "arm string, dimension string, unit string, value int")
    assert analysis.alpha(v).first()["alpha"] == 1.0


def test_ranks_are_exact_and_disjoint(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("s"))
    got = sampling.rank_within(df, ["s"]).groupBy("s").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("k"), F.max("rank").alias("m")).collect()
    assert all(r["n"] == r["k"] == r["m"] for r in got) and len(got) == 2
    s = sampling.partition_slices(df, ["s"], {"a": 30, "b": 60})
    assert {r["slice"]: r["count"] for r in s.groupBy("slice").count().collect()} == {"a": 30, "b": 60} and s.select("id").distinct().count() == 90


def test_split_is_stable_under_repartition(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4).alias("s"))
    cut = lambda x: sorted(map(tuple, sampling.split_by_share(x, ["s"], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("id", "split").collect()))
    assert cut(df) == cut(df.repartition(7))


def test_label_stratified_fills_every_label(spark):
    df = spark.createDataFrame([(f"i{i}", ["a"] if i % 2 else ["a", "b"] if i % 5 else ["c"]) for i in range(200)], "id string, x array<string>")
    n = {r["l"]: r["count"] for r in sampling.label_stratified(df, "x", ["a", "b", "c", "none"], 8).select(F.explode("x").alias("l")).groupBy("l").count().collect()}
    assert n["c"] == 8 and n["b"] == 8 and n["a"] >= 8


def test_empty_tables(spark):
    runs = spark.createDataFrame([], RUNS)
    assert vote.vote(runs).count() == 0 and sampling.rank_within(runs.select(F.col("item_id").alias("id"), "arm"), ["arm"]).count() == 0
    assert retrieve.bm25_top_k(spark.createDataFrame([], "bucket string, id string, text string"), spark.createDataFrame([("q", "a")], "query_id string, text string"), 3).count() == 0


def test_sentinel_codes(spark):
    df = spark.createDataFrame([(None,), ([],), (["x"],)], "x array<string>")
    enc = df.select(kb.encode_meta(F.col("x")).alias("e"))
    assert [r["e"] for r in enc.collect()] == ["__none__", "[]", '["x"]']
    assert [r[0] for r in enc.select(kb.decode_meta(F.col("e"))).collect()] == [None, [], ["x"]]


def test_kb_version_ignores_order(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], "id string, text string")
    b = spark.createDataFrame([("2", None), ("1", "x")], "id string, text string")
    c = spark.createDataFrame([("2", ""), ("1", "x")], "id string, text string")
    v = [kb.kb_version(x, ["id", "text"]).first()["version"] for x in (a, b, c)]
    assert v[0] == v[1] != v[2]


def test_row_diff(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, t string")
    assert [tuple(r) for r in kb.row_diff(a, kb.edit_record(a, "2", "t", "z"), "id", ["t"]).collect()] == [("2", "t", "changed")]


def test_diversify(spark):
    same, far = [1.0, 0.0], [0.0, 1.0]
    rows = [("q", "a", 1, 0.9, same), ("q", "b", 2, 0.9, same), ("q", "c", 3, 0.7, far), ("r", "z", 1, 0.1, same)]
    got = [tuple(x) for x in retrieve.diversify(spark.createDataFrame(rows, "query_id string, id string, rank int, sim double, vec array<double>"), 2).orderBy("query_id", "pick").collect()]
    assert got == [("q", "a", 1), ("q", "c", 2), ("r", "z", 1)]


@pytest.mark.parametrize("sent", [8_000_000, 12])
def test_dense_matches_brute_force(spark, monkeypatch, sent):
    """With queries sent to the records, and in shuffled tiles."""
    import numpy as np

    monkeypatch.setattr(retrieve, "BROADCAST_NUMBERS", sent)
    m = np.random.default_rng(0).normal(size=(60, 5))
    c = spark.createDataFrame([("b", i, v.tolist()) for i, v in enumerate(m)], "bucket string, id long, vec array<double>")
    q = c.filter("id < 7").select(F.col("id").alias("query_id"), "bucket", "vec")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieve.dense_top_k(c, q.drop("bucket"), 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(7):
        assert [got[i, k] for k in (1, 2, 3)] == [j for j in np.argsort(-(u @ u[i])) if j != i][:3]
    near = {(r["query_id"], r["id"]) for r in retrieve.dense_near(c, q, 0.5).collect()}
    assert near == {(i, j) for i in range(7) for j in range(60) if i != j and u[i] @ u[j] >= 0.5}
    assert retrieve.dense_top_k(c.limit(0), q.drop("bucket"), 3).count() == 0 == retrieve.dense_top_k(c, q.drop("bucket").limit(0), 3).count()


@pytest.mark.parametrize("sent", [300_000, 1])
def test_bm25_is_the_same_either_way(spark, monkeypatch, sent):
    import math
    import random

    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", sent)
    rng = random.Random(0)
    docs = {f"d{i:02}": [f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 15))] for i in range(50)} | {"d50": []}
    c = spark.createDataFrame([("b", i, " ".join(w)) for i, w in docs.items()] + [("b", "null", None)], "bucket string, id string, text string")
    q = spark.createDataFrame([("d03", "w1 w1 w2 w9"), ("x", "w5 nothing"), ("y", None), ("z", "nothing")], "query_id string, text string")
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in w for w in docs.values()) for t in {t for w in docs.values() for t in w}}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}

    def score(words, d):
        return sum(idf[t] * docs[d].count(t) * 2.5 / (docs[d].count(t) + 1.5 * (0.25 + 0.75 * len(docs[d]) / avg)) for t in words if t in docs[d])

    want = {}
    for name, words in (("d03", ["w1", "w1", "w2", "w9"]), ("x", ["w5"])):
        best = sorted(((-round(score(words, d), 6), d) for d in docs if d != name and set(words) & set(docs[d])))[:4]
        want |= {(name, d): k for k, (v, d) in enumerate(best, 1) if v < 0}
    assert {(r["query_id"], r["id"]): r["rank"] for r in retrieve.bm25_top_k(c, q, 4).collect()} == want


@pytest.mark.parametrize("strategy", ["bm25", "dense", "hybrid"])
def test_retrieval_call_keeps_budgets(spark, strategy):
    rows = [(f"def-{d}-{i}", "definition", d, "en", f"meaning {d} word {i}") for d in ("hate_type", "hate", "target_group") for i in range(4)]
    rows += [(f"{k}-{lang}-{i}", k, None, lang, f"word sample {i} {lang}") for k in ("guideline", "example", "feedback") for lang in ("en", "de") for i in range(8)]
    k = retrieve.hashed_vectors(spark.createDataFrame(rows, "id string, kind string, dimension string, lang string, text string"))
    q = retrieve.hashed_vectors(spark.createDataFrame([("q", "en", "meaning of a word sample 3"), ("r", None, "word 2")], "query_id string, lang string, text string"))
    cfg = retrieve.BUDGETS | {"strategy": strategy, "definitions_mode": "per_dimension", "use_mmr": True, "feedback": 0, "examples": 3}
    got = retrieve.retrieve(k, q, cfg).collect()
    for name, want in (("q", {"definitions": 3, "guidelines": 2, "examples": 3}), ("r", {"definitions": 3, "guidelines": 2})):
        mine = [r for r in got if r["query_id"] == name]
        assert {b: sum(r["bucket"] == b for r in mine) for b in {r["bucket"] for r in mine}} == want
        assert [r["id"].split("-")[1] for r in sorted(mine, key=lambda r: r["pos"]) if r["bucket"] == "definitions"] == ["hate", "target_group", "hate_type"]
        assert all("-en-" in r["id"] for r in mine if r["bucket"] == "examples")
    flat = retrieve.retrieve(k, q.limit(1), cfg | {"definitions_mode": "flat"}).filter("bucket = 'definitions'")
    assert flat.count() == 2
    with pytest.raises(ValueError, match="strategy"):
        retrieve.retrieve(k, q, cfg | {"strategy": "other"})


def test_prompts_leave_out_empty_sections(spark):
    items = spark.createDataFrame([("1", " a  b "), ("2", "c")], "id string, text string")
    ctx = spark.createDataFrame([("1", "g", 1, "two"), ("1", "g", 0, "one"), ("1", "other", 0, "x")], "item_id string, bucket string, pos int, line string")
    got = {r["item_id"]: r["messages"][1]["text"] for r in prompt.build_prompts(items, ctx, "s", {"d": "D:", "g": "G:"}).collect()}
    assert got == {"1": "G:\n- one\n- two\n\nText: a b", "2": "Text: c"}
    assert prompt.sections_of_template("x\n=== A ===\none\n=== B ===\n\ntwo\n") == {"A": "one", "B": "two"}


def test_mock_run_repairs_once(spark):
    p = spark.createDataFrame([("1", "rag", [("user", "hello")])], "item_id string, arm string, messages array<struct<role string, text string>>")
    r = run.sample_runs(p, lambda: run.MockClient(broken=True), 2).collect()
    assert [x["repairs"] for x in r] == [1, 1] and not any(x["parse_failure"] for x in r) and all(len(x["raw_outputs"]) == 2 for x in r)
    log = run.sample_calls(p, lambda: run.MockClient(broken=True), n_runs=2).collect()
    assert len(log) == 4 and all(x["response_chars"] == len(x["raw"]) and x["prompt_chars"] >= 5 for x in log)
    with pytest.raises(ValueError, match="pinned"):
        run.classify(p, run.MockClient, "a", "b")


def test_calls_fall_back_and_retry():
    seen = []

    class Flaky(run.MockClient):
        def complete(self, model, *a):
            seen.append(model)
            if model == "flaky" and seen.count("flaky") < 3:
                raise run.CallError("passing")
            return super().complete(model, *a)

    assert run.ask(Flaky(), ["flaky"], [], sleep=lambda s: None)[1] == "flaky" and len(seen) == 3
    for kind in ("unavailable", "bad_request", "truncated", "passing"):
        assert run.ask(run.MockClient(failing={"a": kind}), ["a", "b"], [], sleep=lambda s: None)[1] == "b"
        with pytest.raises(run.CallError, match=kind):
            run.ask(run.MockClient(failing={"a": kind}), ["a", "b"], [], fallback=False, sleep=lambda s: None)
    with pytest.raises(run.CallError, match="auth"):
        run.ask(run.MockClient(failing={"a": "auth"}), ["a", "b"], [])
    with pytest.raises(run.CallError, match="no model answered"):
        run.ask(run.MockClient(failing={"a": "truncated"}), ["a"], [])


def test_errors_of_replies():
    kinds = {s: getattr(run.error_of(s), "kind", None) for s in (200, 400, 401, 403, 404, 429, 500, 503)}
    assert kinds == {200: None, 400: "bad_request", 401: "auth", 403: "auth", 404: "bad_request", 429: "passing", 500: "passing", 503: "passing"}
    assert run.error_of(404, "Model not available").kind == "unavailable" and run.error_of(200, "", False).kind == "truncated"


def test_json_lines(spark, tmp_path):
    p = tmp_path / "run_r3_x.jsonl"
    p.write_text('{"_manifest": {"name": "x"}}\n{"item_id": "1", "hate": true}\n\n{"torn\n{"item_id": "1", "hate": false}\n')
    head, rows = jsonl.read_results(spark, str(p), "item_id string, hate boolean")
    assert head.count() == 1 and [tuple(r) for r in jsonl.last_line_wins(rows, ["item_id"]).select("item_id", "hate").collect()] == [("1", False)]
    q = jsonl.line_quality(spark, str(p)).first()
    assert (q["n_lines"], q["n_parsed"], q["n_corrupt"]) == (4, 3, 1)


def test_late_rows_are_an_error(spark, tmp_path):
    import time

    from evalweave.streaming import log

    def part(i, *rows):
        spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(1.1)  # files are taken in order of time

    part(0, ("a", "2025-06-01"), ("b", "2025-06-02"))
    part(1, ("c", "2025-06-02"))
    part(2, ("d", "2025-01-01"))  # the watermark of a batch holds from the one after the next
    schema = "k string, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    with pytest.raises(log.LateRows):
        log.append_new(stream(), ["k"], "ts", "1 day")
    assert log.append_new(stream(), ["k"], "ts", "400 days").count() == 4


def test_line_numbers_of_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) if i % 5 else "" for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r["file"], r["line_no"]): r["value"] for r in jsonl.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("a.txt", i + 1): x for i, x in enumerate(lines) if x} | {("b.txt", 1): "one", ("b.txt", 3): "two"}


def test_values_at_ranks(spark):
    import random

    rng = random.Random(0)
    vals = {"a": [float(rng.randrange(40)) for _ in range(500)], "b": [1.0], None: [3.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs] + [("a", None), ("c", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["mid"], r["last"]) for r in sampling.at_ranks(df, ["k"], "v", {"mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}, edges=7).collect()}
    assert got == {k: (len(v), sorted(v)[len(v) // 2], max(v)) for k, v in vals.items()}


def test_study_odd_input(spark):
    g = spark.createDataFrame([("1", ["x"]), ("2", []), ("3", None), ("4", ["x", "y"])], "id string, l array<string>")
    assert {r["id"]: r["l"] for r in study.exclude_labels(g.filter("l is not null"), "l", ["x"]).collect()} == {"2": [], "4": ["y"]}
    none = spark.createDataFrame([], "item_id string, hit_id string"), spark.createDataFrame([], "id string, labels array<string>"), spark.createDataFrame([], "item_id string, labels array<string>")
    r = study.feedback_reach(*none).first()
    assert (r["n_items"], r["n_reached"], r["n_label_hit"], r["n_used"], r["chance"]) == (0, 0, 0, 0, None)
    batch = spark.createDataFrame([("b", "k1", True), ("a", "k2", True), ("c", "k3", False)], "item_id string, key string, wrong boolean")
    pool = spark.createDataFrame([("p", "k9"), ("q", "k1"), ("r", "kb")], "item_id string, key string")
    got = {tuple(r) for r in study.topped_up_round(batch, pool, spark.createDataFrame([("kb",)], "key string"), 1).collect()}
    assert got == {("feedback", "a", "batch"), ("feedback", "b", "batch"), ("control", "c", "batch"), ("control", "p", "pool")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "i int, arm string")
    assert jsonl.append_missing(df, str(tmp_path / "t"), ["i", "arm"]) == 2 and jsonl.append_missing(df, str(tmp_path / "t"), ["i", "arm"]) == 0
    jsonl.write_frozen(df, str(tmp_path / "f"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jsonl.write_frozen(df, str(tmp_path / "f"))
    jsonl.write_vectors(df, str(tmp_path / "v"), "m", "1")
    assert jsonl.open_vectors(spark, str(tmp_path / "v"), "m").count() == 2
    with pytest.raises(ValueError):
        jsonl.open_vectors(spark, str(tmp_path / "v"), "n")


def test_settings():
    with pytest.raises(ValueError, match="repeated key"):
        config.load_yaml("a: 1\nb:\n  c: 1\n  c: 2\n")
    m = config.resolve(config.Manifest("n", "de_test_eval", temperature=0.0, provider="b"), {"temperature": 1.0})
    assert m.temperature == 0.0 and config.estimate(m, 10) == (90, 585.0)
    assert config.manifest_problems(m, local_only=("de_",))[0] and config.manifest_problems(m)[1]
    assert config.taxonomy_problems({"dimensions": {"hate": {"type": "binary"}, "x": {"type": "multilabel", "labels": {"a": {}}}}}) == ["x.a: no definition"]


def test_text_keys(spark):
    df = spark.createDataFrame([(" A\u00a0 b\n",), (None,)], "t string")
    assert [tuple(r) for r in df.select(text.flatten("t"), text.dedup_key("t")).collect()] == [("A b", "a b"), (None, None)]
    assert text.normalise("\uff21 Stra\u00dfe!") == "a strasse"


def test_distance_bands(spark):
    df = spark.createDataFrame([(f"i{i}", float(i)) for i in range(10)], "item_id string, sim double")
    n = {r["band"]: r["count"] for r in audit.distance_bands(df, 4).groupBy("band").count().collect()}
    assert n == {1: 2, 2: 3, 3: 3, 4: 2}


def test_intermediates_are_dropped(spark):
    from evalweave.session import drop_intermediates, materialise

    drop_intermediates(spark)
    df = materialise(spark.range(3), "x")
    assert df.count() == 3 and drop_intermediates(spark) == 1 and drop_intermediates(spark) == 0


def test_permutation_matches_all_subsets(spark):
    import itertools

    value, band = [1.0, 1.0, 0.0, 1.0, -1.0, 0.0, 0.0, -1.0, 1.0], [1, 1, 1, 2, 2, 2, 3, 3, 3]
    r = analysis.permutation_p(spark.createDataFrame(list(zip(value, band)), "value double, band int")).first()
    near, lead = [], []
    for x in itertools.combinations(range(9), 3):
        for y in itertools.combinations([i for i in range(9) if i not in x], 3):
            a, b = sum(value[i] for i in x) / 3, sum(value[i] for i in y) / 3
            near.append(a >= 2 / 3 - 1e-9)
            lead.append(a - b >= 2 / 3 - 1e-9)
    assert abs(r["p_value"] - sum(near) / len(near)) < 0.02 and abs(r["p_gradient"] - sum(lead) / len(lead)) < 0.02
    assert (r["n_near"], r["n_far"], r["n_permutations"]) == (3, 3, 10_000)


def test_permutation_keeps_a_band_of_thousands(spark):
    near = F.col("id") % 5 == 0  # 60 % right, the others 50 %
    v = spark.range(20_000).select((F.col("id") % 100 < F.when(near, 56).otherwise(50)).cast("double").alias("value"), F.when(near, 1).when(F.col("id") % 5 == 4, 3).otherwise(2).alias("band"))
    assert analysis.permutation_p(v).first()["p_value"] < 1 / 51


def test_full_sizes_match_brute_force(spark):
    import hashlib

    import numpy as np

    n, rng = 30, np.random.default_rng(0)
    truth, a, b = (rng.random((3, n)) < 0.5)
    rows = [(f"i{i:02}", "a", "b", bool(truth[i]), bool(a[i]), bool(b[i])) for i in range(n)]
    r = analysis.paired_bootstrap(spark.createDataFrame(rows, "item_id string, arm_a string, arm_b string, truth boolean, pred_a boolean, pred_b boolean"), audits.B).first()

    def macro(t, q):
        f = lambda t, q: 2 * (t & q).sum() / max(1, 2 * (t & q).sum() + (t ^ q).sum())
        return (f(t, q) + f(~t, ~q)) / 2

    draws = [[int(hashlib.md5(f"{k}-{i}|0".encode()).hexdigest()[:15], 16) % n for i in range(1, n + 1)] for k in range(1, 1001)]
    d = [macro(truth[x], a[x]) - macro(truth[x], b[x]) for x in draws if 0 < truth[x].sum() < n]
    assert r["n_resamples"] == len(d) and np.allclose([r["ci_low"], r["ci_high"], r["sd"]], [*np.quantile(d, [0.025, 0.975]), np.std(d, ddof=1)])
    types = [["x"] if i < 9 else ["y", "z"] if i < 20 else ["y"] for i in range(n)]
    got = {r["n_labels"]: r["n_resamples"] for r in analysis.label_survival(spark.createDataFrame([(f"i{i:02}", x) for i, x in enumerate(types)], "item_id string, labels array<string>"), audits.B, 12).collect()}
    kept = [sum(sum(t in types[i] for i in x) >= 12 for t in "xyz") for x in draws]
    assert got == {k: kept.count(k) for k in set(kept)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_queries_of_full_size(spark):
    d = "/root/testdata/sf0.001"
    assert audits.QUERIES["permutation_test"](spark, d).first()["n_permutations"] == 10_000
    assert {r["n"] for r in audits.QUERIES["threshold_sweep"](spark, d).groupBy("arm").agg(F.countDistinct("threshold").alias("n")).collect()} == {99}
    assert audits.QUERIES["paired_bootstrap"](spark, d).agg(F.max("n_resamples")).first()[0] > 900
    assert audits.QUERIES["label_survival"](spark, d).agg(F.sum("n_resamples")).first()[0] == 1000


def test_leakage_finds_near_copies(spark):
    import itertools
    import random

    rng = random.Random(0)
    texts = {}
    for i in range(40):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))]
        texts[f"e{i}"] = " ".join(w)
        for j in range(3):
            x = list(w)
            for _ in range(j):
                x[rng.randrange(len(x))] = f"w{rng.randrange(300)}"
            texts[f"t{i}-{j}"] = " ".join(rng.sample(x, len(x)))
    side = lambda k: spark.createDataFrame([(i, t, "en ") for i, t in texts.items() if i[0] == k] + [(f"{k}-de", texts["e0"], "de" if k == "e" else "fr"), (f"{k}-null", None, "en")], "id string, text string, lang string")
    e, t = side("e"), side("t")
    bag = {i: set(x.split()) for i, x in texts.items()}
    want = {(a, b) for a, b in itertools.product(texts, texts) if a[0] == "e" and b[0] == "t" and len(bag[a] & bag[b]) ** 2 >= 0.9025 * len(bag[a]) * len(bag[b])}
    pairs = audit.leakage(e, t)
    got = pairs.collect()
    assert {(r["eval_id"], r["train_id"]) for r in got} == want and any(0.95 <= r["sim"] < 1 for r in got)
    assert {r["id"] for r in audit.exclusions(pairs, t).collect()} == {b for _, b in want}


def test_leakage_uses_stored_vectors_in_both_directions(spark):
    none = spark.createDataFrame([], "id string, text string, lang string")
    e = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [0.0, 1.0])], "id string, vec array<double>")
    t = spark.createDataFrame([("t1", [1.0, 0.01]), ("t2", [1.0, 0.1]), ("t3", [1.0, 1.0])], "id string, vec array<double>")
    pairs = audit.leakage(none, none, vectors=(e, t))
    assert {(r["eval_id"], r["train_id"]) for r in pairs.collect()} == {("e1", "t1"), ("e1", "t2")}
    assert {r["id"] for r in audit.exclusions(pairs, t.select("id", F.lit("en").alias("lang"))).collect()} == {"t1", "t2"}


def test_feedback_is_found_and_languages_are_kept_apart(spark, tmp_path):
    kb = [("f1", "feedback", "en", "moon over water"), ("f2", "feedback", "de", "moon over water"), ("x1", "example", " EN", "moon over hills"), ("x2", "example", "de", "moon over hills"), ("g1", "guideline", "en", "moon over towns")]
    kb += [(f"{k}{lang}{i}", k, lang, f"other words {i} here") for k in ("feedback", "example", "guideline") for lang in ("en", "de") for i in range(4)]
    spark.createDataFrame(kb, "id string, kind string, lang string, text string").withColumn("ingested_at", F.lit(None).cast("timestamp")).write.parquet(str(tmp_path / "kb_hits.parquet"))
    items = spark.createDataFrame([("a-50", "en", "moon"), ("a-100", "de", "moon"), ("a-150", None, "moon")], "id string, lang string, text string").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    items.write.parquet(str(tmp_path / "gold_items.parquet"))
    got = {(r["query_id"], r["bucket"], r["id"]) for r in retrieval.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert got == {("a-50", "guideline", "g1"), ("a-50", "example:en", "x1"), ("a-50", "feedback:en", "f1"), ("a-100", "guideline", "g1"), ("a-100", "example:de", "x2"), ("a-100", "feedback:de", "f2"), ("a-150", "guideline", "g1")}
    assert {r["bucket"]: r["n"] for r in retrieval.QUERIES["bm25_stats"](spark, str(tmp_path)).collect()} == {"guideline": 9, "example:en": 5, "example:de": 5, "feedback:en": 5, "feedback:de": 5}


@pytest.mark.parametrize("sent", [4_000_000, 300])
def test_bm25_searches_long_queries_without_joining_terms(spark, monkeypatch, sent):
    """Many records and long queries: nothing is joined term by term, and the best are those of adding up everything."""
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", sent)
    monkeypatch.setattr(retrieve, "POSTINGS", 4_000, raising=False)
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 3000}"
    docs = {i: [word() for _ in range(rng.randint(5, 60))] for i in range(700)}
    for i in range(0, 700, 7):  # copies tie
        docs[1000 + i] = rng.sample(docs[i], len(docs[i]))
    asked = [i for i in docs if i % 50 == 0]
    c = spark.createDataFrame([("b" if i % 3 else "a", i, " ".join(w)) for i, w in docs.items()], "bucket string, id long, text string")
    q = spark.createDataFrame([(i, " ".join(docs[i] + docs[i][:9]), "a") for i in asked], "query_id long, text string, bucket string")
    mine = {i: Counter(w) for i, w in docs.items() if i % 3 == 0}
    n, avg = len(mine), sum(sum(w.values()) for w in mine.values()) / len(mine)
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in Counter(t for w in mine.values() for t in w).items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    want = {}
    for i in asked:
        words = Counter(docs[i] + docs[i][:9])
        score = {d: sum(k * idf[t] * w[t] * 2.5 / (w[t] + 1.5 * (0.25 + 0.75 * sum(w.values()) / avg)) for t, k in words.items() if t in w) for d, w in mine.items() if d != i}
        want |= {(i, d): (r, round(s, 5)) for r, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5], 1) if s > 0}
    top = retrieve.bm25_top_k(c, q, 5)
    assert "Join" not in top._jdf.queryExecution().toString()
    assert {(r["query_id"], r["id"]): (r["rank"], round(r["score"], 5)) for r in top.collect()} == want


def test_dense_search_keeps_the_best_of_a_task_and_of_the_buckets_wanted(spark):
    import numpy as np

    m = np.random.default_rng(2).normal(size=(900, 4))
    m[100:200] = m[:100]  # ties
    c = spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(m)], "bucket string, id long, vec array<double>").repartition(1)
    q = c.filter("id < 20").select(F.col("id").alias("query_id"), "vec")
    wanted = q.select("query_id", F.lit("b").alias("bucket")).filter("query_id < 10")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = lambda i, b: sorted((j for j in range(900) if j != i and "ab"[j % 2] == b), key=lambda j: (-round(u[i] @ u[j], 6), j))[:3]
    got = retrieve.dense_top_k(c, q, 3, wanted).collect()
    assert {(r["query_id"], r["bucket"], r["rank"]): r["id"] for r in got} == {(i, "b", k): j for i in range(10) for k, j in enumerate(best(i, "b"), 1)}
    got = retrieve.dense_scored(c, q, 3, 100)
    assert got.count() <= 20 * 2 * 4
    assert {(r["query_id"], r["bucket"], r["rank"]): r["id"] for r in retrieve.top_k(got, ["query_id", "bucket"], 3).collect()} == {(i, b, k): j for i in range(20) for b in "ab" for k, j in enumerate(best(i, b), 1)}


def test_a_run_reads_each_answer_once(spark):
    text = "item_id string, arm string, messages array<struct<role string, text string>>"
    p = spark.createDataFrame([(str(i), "rag", [("system", "s"), ("user", f"hello {i}")]) for i in range(20)], text)
    voted = run.classify(p, lambda: run.MockClient(broken=True), "m", "m", 2)
    assert "Python" not in (plan := voted._jdf.queryExecution().toString()) and "variant" not in plan
    assert all(r["n_valid"] == 2 for r in voted.collect()) and voted.count() == 20

    class Twice(run.MockClient):
        """Answers the third time only, and then only if it is shown both its answers before."""

        def complete(self, model, messages, attempt=0, salt=""):
            assert len(messages) == 2 + 2 * attempt and messages[1]["text"].startswith("hello")
            return super().complete(model, messages, attempt, salt) if attempt == 2 else "no"

    assert {(r["repairs"], r["parse_failure"], len(r["raw_outputs"])) for r in run.sample_runs(p, Twice, 2).collect()} == {(2, False, 3)}


def test_bm25_scores_exactly_only_what_may_be_among_the_best(spark, monkeypatch):
    """Terms are counted by record and stored; of a block few records are scored twice, also where a query's own are repeated."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, words, k = 3000, 400, 5
    tf = rng.poisson(0.05 + 2.0 * (np.arange(words) < 30), (n, words))
    tf[100:110] = tf[7]  # ties
    ids = np.array([f"d{i:04}" for i in range(n)], object)
    ids[200:212] = "q0"
    tf[200:212] = tf[0] = 1 + tf[0]
    rec, term = np.nonzero(tf)
    idf, dl = rng.uniform(0.1, 9, words), tf.sum(1)
    idf[:3] = -0.5
    asked = rng.integers(0, n, 200)
    asked[0] = 0
    at = [np.flatnonzero(tf[i]) for i in asked]
    scored, exact = [], retrieve._Index.exact
    monkeypatch.setattr(retrieve._Index, "exact", lambda self, recs, w: scored.append(len(recs)) or exact(self, recs, w))
    best, names = {}, np.array([f"q{j}" for j in range(len(asked))], object)
    index = retrieve._Index(ids, dl, (tf > 0).sum(1), term, tf[rec, term], dl.mean(), words)
    index.search(idf, names, np.arange(len(asked)), np.append(0, np.cumsum([len(x) for x in at])), np.concatenate(at), np.ones(sum(map(len, at)), int), k, best)
    grown = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / dl.mean())[:, None])
    for j, t in enumerate(at):
        all_ = np.where(ids == names[j], -np.inf, grown[:, t] @ idf[t])
        cut = np.sort(all_)[-k] - 1e-6
        assert {x: round(y, 6) for x, y in zip(best[j][1], best[j][0]) if y >= cut} == {ids[i]: round(all_[i], 6) for i in np.flatnonzero(all_ >= cut)}
    assert sum(scored) <= 200 * (k + 2) + 2 * 13 + 20
    c = spark.createDataFrame([("b", "1", "x y x"), ("b", "2", "x Zz"), ("b", "3", "..."), ("b", "4", None)], "bucket string, id string, text string")
    counted = retrieve.term_counts(c)
    assert {r["id"]: (r["dl"], dict(zip(r["terms"], r["tfs"]))) for r in counted.collect()} == {"1": (3, {"x": 2, "y": 1}), "2": (2, {"x": 1, "zz": 1}), "3": (0, {})}
    sizes, weights = retrieve.bm25_stats(counted)
    assert "Generate" not in weights._jdf.queryExecution().toString()
    assert {r["term"]: r["df"] for r in weights.collect()} == {"x": 2, "y": 1, "zz": 1} and sizes.first()["n"] == 3


def test_bm25_meets_terms_of_like_queries_as_products_and_scores_no_record_without_a_term(monkeypatch):
    """Terms of a twenty-fifth of the records that many queries of a block have are not added query by query; a query that meets
    fewer than asked for has only those scored."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, half, queries, k = 4000, 40, 512, 5
    kind = rng.integers(0, 2, n)
    tf = rng.poisson(0.08, (n, 2 * half + 1))
    tf[kind == 0, half : 2 * half] = tf[kind == 1, :half] = 0
    tf[:, -1] = 0
    tf[17, -1] = 1
    of = np.arange(queries) % 2
    at = [np.sort(rng.choice(half, 20, False)) + half * o for o in of]
    at[7] = np.array([2 * half])
    start, flat = np.append(0, np.cumsum([len(x) for x in at])), np.concatenate(at)
    order = retrieve._alike(start, flat, 2 * half + 1, 2)
    assert sorted(order) == list(range(queries)) and np.count_nonzero(np.diff(of[order])) <= 3
    rec, term = np.nonzero(tf)
    dl, idf, ids = 1 + tf.sum(1), rng.uniform(1, 4, 2 * half + 1), np.arange(n)
    scored, added, exact, add = [], [], retrieve._Index.exact, retrieve._Index._add
    monkeypatch.setattr(retrieve._Index, "exact", lambda self, recs, w: scored.append(len(recs)) or exact(self, recs, w))
    monkeypatch.setattr(retrieve._Index, "_add", lambda self, sums, t, w: added.append(self.count[t].sum()) or add(self, sums, t, w))
    best, names = {}, np.arange(n, n + queries)
    some = np.flatnonzero((tf > 0).any(1))
    place = np.searchsorted(some, rec)
    index = retrieve._Index(ids[some], dl[some], np.bincount(place), term, tf[rec, term], dl.mean(), 2 * half + 1)
    index.search(idf, names, order, start, flat, np.ones(len(flat), int), k, best)
    assert sum(added) < 0.05 * (tf > 0).sum(0)[flat].sum() and best[7][1].tolist() == [17] and 1 in scored and sum(scored) < 8 * k * queries
    grown = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / dl.mean())[:, None])
    for j, t in enumerate(at):
        score = grown[:, t] @ idf[t]
        cut = max(np.sort(score)[-k] - 1e-6, 1e-9)
        assert {x: round(y, 6) for x, y in zip(best[j][1].tolist(), best[j][0]) if y >= cut} == {i: round(score[i], 6) for i in np.flatnonzero(score >= cut).tolist()}


def test_words_are_split_a_batch_at_once(spark):
    from evalweave.functions.text import split_words, tokens

    texts = ["", "a", "b_1", "", "naïve cafés -- 12,5", "日本語 テキスト", "😀a😀", "a😀", "é", "é́x", "...", "हिन्दी भाषा", "x\u00a0y", "٣ 4²", "ab", "cd"]
    want = [r["w"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", tokens("text").alias("w")).orderBy("i").collect()]
    for first in (0, 3):
        words, n = split_words(pa.array(texts).slice(first))
        ends = n.cumsum().tolist()
        assert [words.to_pylist()[z - m : z] for z, m in zip(ends, n.tolist())] == want[first:]
    assert split_words(pa.array([], pa.string()))[1].tolist() == [] and split_words(pa.array(["", ""]))[1].tolist() == [0, 0]


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_diversify_streams_sorted_queries(spark, rows):
    """No frame a query, and a query may go over batches."""
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 3))
    pool = {q: [(i, float(rng.uniform())) for i in rng.permutation(40)[: 3 + 4 * q].tolist()] for q in range(6)}
    df = spark.createDataFrame([(q, i, r, sim, m[i].tolist()) for q, x in pool.items() for r, (i, sim) in enumerate(x, 1)], "query_id long, id long, rank int, sim double, vec array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        picked = retrieve.diversify(df.orderBy("id"), 5)
        assert "Pandas" not in picked._jdf.queryExecution().toString()
        got = {(r["query_id"], r["pick"]): r["id"] for r in picked.collect()}
        assert retrieve.diversify(df.limit(0), 5).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    u, want = m / np.linalg.norm(m, axis=1, keepdims=True), {}
    for q, x in pool.items():
        left, order = dict(x), []
        while left and len(order) < 5:
            i = next(iter(left)) if len(x) <= 5 else max(left, key=lambda i: 0.7 * left[i] - 0.3 * max((u[i] @ u[j] for j in order), default=0))
            order.append(i)
            del left[i]
        want |= {(q, k): i for k, i in enumerate(order, 1)}
    assert got == want


def test_fused_search_reads_the_documents_texts_no_more_than_needed(spark, tmp_path):
    """The stored vectors of documents are found once, not anew for size, queries and search."""
    from evalweave.plans import studies

    docs = spark.createDataFrame([(i, f"word{i % 7} thing{i % 3} text {i}" if i % 11 else None) for i in range(120)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(0, 200, 2)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    top = studies.retrieval_debug(spark, str(tmp_path))
    assert top._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<doc_id:bigint") == 1
    assert {(r["query_id"], r["rank"]) for r in top.collect()} == {(q, k) for q in (50, 100) for k in (1, 2, 3)}


def test_a_retrieval_call_reads_its_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for x in frames:
            read.add(len(x))
            yield x

    rows = [(f"{kind}{i}", kind, "hate", "en", f"word{i} text") for kind in ("definition", "guideline", "example", "feedback") for i in range(5)]
    records = spark.createDataFrame(rows, fields := "id string, kind string, dimension string, lang string, text string").mapInPandas(seen, fields)
    asked = spark.createDataFrame([("q", "en", "word3")], "query_id string, lang string, text string")
    got = retrieve.retrieve(records, asked, retrieve.BUDGETS | {"strategy": "bm25", "definitions_mode": "proportional"}).collect()
    assert {(r["bucket"], r["id"]) for r in got} == {("definitions", "definition3"), ("guidelines", "guideline3"), ("examples", "example3"), ("feedback", "feedback3")}
    assert read.value == len(rows)
