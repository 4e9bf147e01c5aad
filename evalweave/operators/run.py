"""A classification run: prompts to answers to votes.

Only the call to a model runs in Python, with a client for each partition. Answers are stored, read by the parser as any
logged answer is, and those rejected are asked again with the error shown, in as many rounds as repairs are allowed.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.labels import TAXONOMY
from evalweave.operators.parse import parse_answers
from evalweave.operators.vote import vote
from evalweave.session import materialise

CORRECTION = "The answer before was rejected: {}. Answer again with the JSON object alone."
#: Errors that concern one request or one model: another model may still answer.
ELSEWHERE = {"unavailable", "bad_request", "truncated", "passing"}


class CallError(Exception):
    """A failed call. ``kind`` is auth, unavailable, bad_request, truncated or passing (network, rate limit, server)."""

    def __init__(self, kind: str, text: str = "") -> None:
        super().__init__(f"{kind}: {text}")
        self.kind = kind


def error_of(status: int, body: str = "", complete: bool = True) -> CallError | None:
    """The error that a reply's status, text and completeness stand for, or None."""
    if status in (401, 403):
        return CallError("auth", str(status))
    if status >= 400 and "not available" in body.lower():
        return CallError("unavailable", body[:200])
    if status == 429 or status >= 500:
        return CallError("passing", str(status))
    if status >= 400:
        return CallError("bad_request", f"{status} {body[:300]}")
    return None if complete else CallError("truncated", "the answer reached its token limit")


class MockClient:
    """Answers from a digest of the prompt: the same everywhere. With ``broken`` the first answer of a run is cut; models in
    ``failing`` raise the kind of error given."""

    def __init__(self, broken: bool = False, failing: Mapping[str, str] | None = None) -> None:
        self.broken, self.failing = broken, dict(failing or {})

    def complete(self, model: str, messages: list[dict], attempt: int = 0, salt: str = "") -> str:
        if kind := self.failing.get(model):
            raise CallError(kind, model)
        h = hashlib.md5((salt + json.dumps(messages[:2], ensure_ascii=False, sort_keys=True)).encode()).digest()
        hate = h[0] % 3 == 0
        pick = lambda d, b: [TAXONOMY[d][b % len(TAXONOMY[d])]] if hate else []
        out = json.dumps({"reasoning": "By digest.", "hate": hate, "target_group": pick("target_group", h[1]), "hate_type": pick("hate_type", h[2]), "severity": TAXONOMY["severity"][h[3] % 3] if hate else None, "legal": []})
        return out[: len(out) // 2] if self.broken and not attempt else out


#: Providers by name; a deployment adds its own, each a function that makes a client.
PROVIDERS: dict[str, Callable[[], MockClient]] = {"mock": MockClient, "mock-broken": lambda: MockClient(broken=True)}


def ask(client, models: Sequence[str], messages: list[dict], attempt: int = 0, salt: str = "", fallback: bool = True, tries: int = 5, base_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(answer, model that gave it). Passing errors are tried again after growing waits, then the next model is asked."""
    failed = []
    for model in models:
        for i in range(tries):
            try:
                return client.complete(model, messages, attempt, salt), model
            except CallError as e:
                if e.kind == "passing" and i < tries - 1:
                    sleep(base_s * 2**i)
                    continue
                if e.kind not in ELSEWHERE or not fallback:
                    raise
                failed.append(f"{model} {e}")
                break
    raise CallError("unavailable", "no model answered; " + "; ".join(failed))


_CALL = "item_id string, arm string, run_idx int, attempt int, ts timestamp, model string, raw string, prompt_chars long, response_chars long, latency_s double"


def calls(asked: DataFrame, client: Callable[[], MockClient], models: Sequence[str], attempt: int, fallback: bool = True) -> DataFrame:
    """One call for each row of ``asked(item_id, arm, run_idx, messages)``: the answer and what a call log keeps.

    Each partition makes its own client, so the number of partitions bounds concurrent calls.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for pdf in it:
            rows = []
            for item, arm, run_idx, messages in zip(pdf["item_id"], pdf["arm"], pdf["run_idx"], pdf["messages"]):
                talk, began = [{"role": m["role"], "text": m["text"]} for m in messages], time.time()
                raw, model = ask(c, models, talk, attempt, f"{arm}|{run_idx}", fallback)
                rows.append((item, arm, run_idx, attempt, int(began * 1e6), model, raw, sum(len(m["text"]) for m in talk), len(raw), time.time() - began))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _CALL.split(", ")]).astype({"run_idx": "int32", "attempt": "int32"})
            yield out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    return asked.select("item_id", "arm", "run_idx", "messages").mapInPandas(run, _CALL)


def sample_calls(prompts: DataFrame, client: Callable[[], MockClient], models: Sequence[str] = ("mock-1",), n_runs: int = 3, max_repairs: int = 2, fallback: bool = True) -> DataFrame:
    """Every call of the runs of ``prompts(item_id, arm, messages)``, read: the calls' columns and those of the parser.

    Each round's answers are written before they are read: calls are dear and serve many votes. What is read from them is
    written too, once for the next round and the votes. Only the turns added travel with a run, not the prompt.
    """
    prompts = prompts.select("item_id", "arm", "messages")
    # small prompts would else be asked one after the other
    spread = prompts.repartition(4 * prompts.sparkSession.sparkContext.defaultParallelism, "item_id", "arm")
    asked = spread.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    made = more = None
    for attempt in range(max_repairs + 1):
        answers = materialise(calls(asked, client, models, attempt, fallback), "calls")
        read = materialise(parse_answers(answers.withColumn("_raw", F.col("raw")), "_raw"), "calls-read")
        made = read if made is None else made.unionByName(read)
        if attempt < max_repairs:
            turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
            back = F.concat(F.lit(CORRECTION.split("{}")[0]), F.col("error"), F.lit(CORRECTION.split("{}")[1]))
            wrong = read.filter("error is not null").select("item_id", "arm", "run_idx", F.array(turn("assistant", F.col("raw")), turn("user", back)).alias("more"))
            more = wrong if more is None else more.withColumnRenamed("more", "before").join(wrong, ["item_id", "arm", "run_idx"]).select("item_id", "arm", "run_idx", F.concat("before", "more").alias("more"))
            asked = spread.join(more, ["item_id", "arm"]).select("item_id", "arm", "run_idx", F.concat("messages", "more").alias("messages"))
    return made


def sample_runs(prompts: DataFrame, client: Callable[[], MockClient], n_runs: int = 3, max_repairs: int = 2, models: Sequence[str] = ("mock-1",), fallback: bool = True) -> DataFrame:
    """One row a run: its last answer read, with all raw answers, repairs, repairs of spelling and the time it took."""
    made = sample_calls(prompts, client, models, n_runs, max_repairs, fallback)
    last = F.max_by(F.struct("reasoning", "hate", "target_group", "hate_type", "severity", "legal", "gate_normalised", "error", "model"), "attempt").alias("r")
    # at most one answer for each repair allowed
    each = made.groupBy("item_id", "arm", "run_idx").agg(last, F.transform(F.array_sort(F.collect_list(F.struct("attempt", "raw"))), lambda x: x["raw"]).alias("raw_outputs"), F.max("attempt").alias("repairs"), F.sum("normalisations").cast("int").alias("normalisations"), F.sum("latency_s").alias("latency_s"))
    fields = [F.col(f"r.{c}").alias(c) for c in ("reasoning", "hate", "target_group", "hate_type", "severity", "legal")]
    return each.select("item_id", "arm", "run_idx", "raw_outputs", *fields, "repairs", "normalisations", F.coalesce("r.gate_normalised", F.lit(False)).alias("gate_normalised"), F.col("r.error").isNotNull().alias("parse_failure"), F.col("r.error").alias("error_msg"), "latency_s", F.col("r.model").alias("active_model"))


def classify(prompts: DataFrame, client: Callable[[], MockClient], model: str, served: str, n_runs: int = 3) -> DataFrame:
    """Voted and stamped predictions. A served model other than the pinned one is an error before the first call."""
    if model != served:
        raise ValueError(f"pinned model {model}, served {served}")
    runs = materialise(sample_runs(prompts, client, n_runs, models=(model,), fallback=False), "runs")  # the vote reads them thrice
    return vote(runs).withColumn("active_model", F.lit(model))
