"""From a model's raw answer to a validated prediction, with every repair counted.

Answers are read as VARIANT and checked field by field against ``RULES`` in the JVM. Only answers whose JSON must first be
cut out of prose, or in which two keys mean one field, pass through Python, which returns plain JSON.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.labels import TAXONOMY

# Other spellings of the field names, and of truth values and absence.
ALIASES = {"target_groups": "target_group", "hate_types": "hate_type", "is_hate": "hate", "hateful": "hate", "legal_class": "legal", "legal_classes": "legal", "legals": "legal"}
TRUE, FALSE, ABSENT = {"true", "yes", "1"}, {"false", "no", "0"}, {"none", "null", "n/a", ""}


@dataclass(frozen=True)
class Rule:
    """What a field may hold: ``text``, ``truth``, one ``label`` of the taxonomy or a list of ``labels``."""

    field: str
    kind: str


RULES = (Rule("reasoning", "text"), Rule("hate", "truth"), Rule("target_group", "labels"), Rule("hate_type", "labels"), Rule("legal", "labels"), Rule("severity", "label"))
SCHEMA = "reasoning string, hate boolean, target_group array<string>, hate_type array<string>, severity string, legal array<string>, normalisations int, gate_normalised boolean, error string"
_OUT = [f.split()[0] for f in SCHEMA.split(", ")]
_SPACE = "(?U)^\\s+|\\s+$"


# ---- the text of the object


def answer_text(raw: Column) -> Column:
    """The answer without traces, outer fences and surrounding space."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?is)<think>.*?</think>", ""), _SPACE, "")
    return F.regexp_replace(F.regexp_replace(bare, "(?i)\\A```(?:json)?\\s*|\\s*```\\z", ""), _SPACE, "")


def whole_objects(text: str) -> str:
    """The first balanced object in ``text``; braces inside strings do not count. An open one is given to its end, and
    without a brace the text itself is given."""
    depth, first = 0, None
    # strings are consumed whole, an unclosed one to the end
    for token in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', text, re.S) if "{" in text else ():
        sign = token.group()
        if sign == "{":
            first, depth = token.start() if first is None else first, depth + 1
        elif sign == "}" and first is not None:
            depth -= 1
            if not depth:
                return text[first : token.end()]
    if first is None:  # a quote in the prose may hide the brace
        first = text.find("{")
        return whole_objects(text[first:]) if first > 0 else text
    return text[first:]


def salvage(text: str | None) -> tuple[str | None, int, str | None]:
    """(plain JSON, keys renamed, error) of a hard answer: of keys that mean one field the last one stays."""
    if text is None:
        return None, 0, None
    start = text.find("{")
    try:
        read = json.loads(whole_objects(text[start:] if start >= 0 else text), object_pairs_hook=_Pairs)
    except (ValueError, RecursionError) as e:
        return None, 0, f"invalid JSON: {e}"
    if not isinstance(read, _Pairs):
        return None, 0, f"no object but {type(read).__name__}"
    last = dict(read)  # a key given twice counts once
    named = {key: ALIASES.get(word := key.strip().lower(), word) for key in last}
    return json.dumps({named[key]: _plain(value) for key, value in last.items()}), sum(key != name for key, name in named.items()), None


class _Pairs(list):
    """The members of a JSON object in order."""


def _plain(value):
    return {k: _plain(v) for k, v in value} if isinstance(value, _Pairs) else [_plain(v) for v in value] if isinstance(value, list) else value


# ---- the fields of the object


def _name(key: Column) -> Column:
    word = F.lower(F.regexp_replace(key, _SPACE, ""))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), word), word)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _value_of(field: str) -> Column:
    return F.try_element_at(F.filter("_fields", lambda e: e["name"] == field), F.lit(1))["value"]


def _label(word: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(word, _SPACE, "")), "[ -]", "_")


def _said(field: str) -> Column:
    """The words of a label field: one, a list, or none for null. NULL for anything else; numbers and the like in a list
    are kept as their text behind a mark no label has."""
    value, kind, text = F.col(f"_v_{field}"), F.col(f"_k_{field}"), F.col(f"_t_{field}")
    each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.concat(F.lit("#"), F.coalesce(F.to_json(v), F.lit("null")))))
    return F.when(text.isNotNull(), F.array(text)).when(kind.startswith("ARRAY"), each).when(kind.isNull() | (kind == "VOID"), F.array().cast("array<string>"))


def _changed(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.startswith("#") & (_label(w) != w)))


def _read(rule: Rule) -> tuple[Column, Column, Column]:
    """(value, repairs, error) of one field, from its value, the value's kind and, of a string, its text."""
    value, kind, text, no = F.col(f"_v_{rule.field}"), F.col(f"_k_{rule.field}"), F.col(f"_t_{rule.field}"), F.lit(0)
    if rule.kind == "text":
        return text, no, F.when(text.isNull(), F.lit(f"{rule.field} is no text"))
    if rule.kind == "truth":
        word = F.lower(F.regexp_replace(text, _SPACE, ""))
        read = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        return read, F.when(word.isin(*TRUE, *FALSE), 1).otherwise(0), F.when(kind.isNull() | ((kind != "BOOLEAN") & ~F.coalesce(word.isin(*TRUE, *FALSE), F.lit(False))), F.lit(f"{rule.field} is no truth value"))
    known = F.array(*[F.lit(x) for x in TAXONOMY[rule.field]])
    if rule.kind == "labels":
        said = F.col(f"_s_{rule.field}")
        labels = F.transform(said, lambda w: F.when(w.startswith("#"), w).otherwise(_label(w)))
        bad = F.filter(labels, lambda x: ~F.array_contains(known, x))
        # one word where a list belongs, and an explicit null, are repairs of their own
        repairs = F.coalesce(_changed(said), no) + F.when(text.isNotNull() | F.coalesce(kind == "VOID", F.lit(False)), 1).otherwise(0)
        return labels, repairs, F.when(said.isNull(), F.lit(f"{rule.field} is no list")).otherwise(F.concat(F.lit(f"unknown {rule.field}: "), F.get(bad, 0)))
    word = _label(text)
    read = F.when(~word.isin(*ABSENT), word)
    odd = kind.isNotNull() & (kind != "VOID") & text.isNull()
    return read, F.when(word != text, 1).otherwise(0), F.when(odd | (read.isNotNull() & ~F.array_contains(known, read)), F.concat(F.lit(f"unknown {rule.field}: "), F.coalesce(read, F.to_json(value))))


def parse_answers(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the SCHEMA columns read from ``column``; an answer in error has everything else NULL.

    The first error in the order of the rules is given; a field that no rule names comes before them. Labels on an answer
    that says no hate are cleared and flagged, but for ``legal``.
    """
    text = answer_text(F.col(column))
    direct = F.try_parse_json(F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit("")))
    x = df.withColumn("_text", text).withColumn("_direct", direct)
    names = F.transform(F.map_keys(F.try_variant_get("_direct", "$", "map<string,variant>")), _name)
    x = x.withColumn("_easy", F.coalesce(_is(F.col("_direct"), "OBJECT") & (F.size(names) == F.size(F.array_distinct(names))), F.lit(False)))

    @F.pandas_udf("json string, renamed int, error string")
    def hard(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvage(a) for a in answers], columns=["json", "renamed", "error"])

    x = x.withColumn("_hard", hard(F.when(~F.col("_easy"), F.col("_text"))))
    x = x.withColumn("_object", F.try_variant_get(F.when(F.col("_easy"), F.col("_direct")).otherwise(F.try_parse_json("_hard.json")), "$", "map<string,variant>"))
    x = x.withColumn("_fields", F.transform(F.map_entries("_object"), lambda e: F.struct(_name(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value"))))
    renamed = F.size(F.filter("_fields", lambda e: e["name"] != e["key"])) + F.coalesce(F.col("_hard.renamed"), F.lit(0))
    extra = F.array_sort(F.filter(F.transform("_fields", lambda e: e["name"]), lambda n: ~n.isin(*[r.field for r in RULES])))
    x = x.withColumns({f"_v_{r.field}": _value_of(r.field) for r in RULES})
    x = x.withColumns({f"_k_{r.field}": F.schema_of_variant(f"_v_{r.field}") for r in RULES})
    x = x.withColumns({f"_t_{r.field}": F.when(F.col(f"_k_{r.field}") == "STRING", F.try_variant_get(f"_v_{r.field}", "$", "string")) for r in RULES})
    x = x.withColumns({f"_s_{r.field}": _said(r.field) for r in RULES if r.kind == "labels"})
    read = {r.field: _read(r) for r in RULES}
    missing = F.when(F.col("_object").isNull(), F.coalesce("_hard.error", F.lit("invalid JSON")))
    error = F.coalesce(missing, F.when(F.size(extra) > 0, F.concat(F.lit("unexpected field "), extra[0])), *[e for _, _, e in read.values()])
    count = sum((n for _, n, _ in read.values()), renamed)
    x = x.withColumns({f"_r_{k}": v for k, (v, _, _) in read.items()} | {"_error": error, "_n": F.when(F.col("_object").isNull(), 0).otherwise(count).cast("int")})
    ok = F.col("_error").isNull()
    clash = ~F.col("_r_hate") & ((F.size("_r_target_group") > 0) | (F.size("_r_hate_type") > 0) | F.col("_r_severity").isNotNull())
    cleared = {"target_group": F.array().cast("array<string>"), "hate_type": F.array().cast("array<string>"), "severity": F.lit(None).cast("string")}
    out = {f: F.when(ok, F.when(clash, cleared[f]).otherwise(F.col(f"_r_{f}")) if f in cleared else F.col(f"_r_{f}")) for f in read}
    out |= {"normalisations": F.col("_n"), "gate_normalised": F.when(ok, clash), "error": F.col("_error")}
    return x.select(*[F.col(f"`{c}`") for c in df.columns if c != column and c not in _OUT], *[out[c].alias(c) for c in _OUT])


def parse_runs(runs: DataFrame) -> DataFrame:
    """(run_id, prediction, repairs, normalisations, parse_failure) of ``runs(run_id, raw_outputs)``.

    Attempts are rows; the first that validates is the run's answer and the attempts before it its repairs; repairs of
    spelling count over every attempt up to it.
    """
    attempts = runs.select("run_id", F.posexplode("raw_outputs").alias("attempt", "raw"))
    read = parse_answers(attempts, "raw").withColumn("ok", F.col("error").isNull())
    first = read.groupBy("run_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("hit"),
        F.min_by(F.struct("reasoning", "hate", "target_group", "hate_type", "severity", "legal", "gate_normalised"), F.when(F.col("ok"), F.col("attempt"))).alias("r"),
        F.max("attempt").alias("last"),
        F.sort_array(F.collect_list(F.struct("attempt", "normalisations"))).alias("n"),
    )
    upto = F.coalesce("hit", "last")
    counted = F.aggregate(F.filter("n", lambda x: x["attempt"] <= upto), F.lit(0), lambda s, x: s + x["normalisations"])
    return first.select("run_id", *[F.col(f"r.{c}").alias(c) for c in ("reasoning", "hate", "target_group", "hate_type", "severity", "legal", "gate_normalised")], upto.alias("repairs"), counted.alias("normalisations"), F.col("hit").isNull().alias("parse_failure"))
