"""SQL for the problems' queries that SQL can state. The others are tested against brute force in tests/llm.

The consistent form is stated over the look-alike classes: code points are mapped one by one and composed canonically.
Similarity is stated over all pairs that share a word, groups as the closure of links.
"""

from __future__ import annotations

from functools import lru_cache

from evalweave.llm import lookalike

_PLAN = """
with ids as (select distinct id, lower(trim(kind)) as kind, lower(trim(lang)) as lang, lower(trim(source)) as source from kb_hits where id is not null),
n as (select count(distinct id) as n from ids),
have as (
  select t.target_id, count(distinct i.id) as available
  from sample_targets t left join ids i
    on (t.kind is null or lower(trim(t.kind)) = i.kind) and (t.lang is null or lower(trim(t.lang)) = i.lang)
   and (t.source is null or lower(trim(t.source)) = i.source)
  group by t.target_id),
plan as (
  select t.target_id, t.plan_key, cast(floor(t.sample_share * n.n) as bigint) as sample_n, h.available,
         greatest(cast(t.min_rows as double), t.target_share * floor(t.sample_share * n.n)) as needed,
         least(greatest(cast(t.min_rows as bigint), cast(round(t.target_share * floor(t.sample_share * n.n)) as bigint)), h.available) as quota
  from sample_targets t join have h using (target_id) cross join n)
"""


@lru_cache(maxsize=1)
def _signs() -> str:
    """(c, v): what each code point stands for."""
    pairs = dict(lookalike.ConsistentForm.default().pairs)
    return "signs(c, v) as (values " + ", ".join(f"(chr({ord(k)}), {_text(v)})" for k, v in sorted(pairs.items()) if len(k) == 1) + ")"


def _text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s) or "''"


def _forms(rows: str) -> str:
    """CTEs down to ``forms(side, id, text, form)`` of the rows' first text per id; ``rows`` selects side, id, text, ingested_at."""
    emoji = lookalike._EMOJI
    held = [f"regexp_replace({{}}, '([{emoji}\ufe0f])\u200d([{emoji}])', '\\1\ue00d\\2', 'g')"] * 2
    held += ["regexp_replace({}, '([\u0600-\u0dff])\u200c', '\\1\ue00c', 'g')", "regexp_replace({}, '([\u0600-\u0dff])\u200d', '\\1\ue00d', 'g')", "regexp_replace({}, '\u200c([\u0600-\u0dff])', '\ue00c\\1', 'g')", "regexp_replace({}, '\u200d([\u0600-\u0dff])', '\ue00d\\1', 'g')"]
    kept = "text"
    for h in held:
        kept = h.format(kept)
    mapped = lambda source, target: f"""
{target}(side, id, text, form) as (
  select x.side, x.id, any_value(x.text), nfc_normalize(coalesce(string_agg(coalesce(s.v, x.c), '' order by x.i), ''))
  from (select side, id, text, unnest(regexp_extract_all(form, '(?s).')) as c, generate_subscripts(regexp_extract_all(form, '(?s).'), 1) as i from {source}) x left join signs s using (c) group by x.side, x.id)"""  # noqa: E731
    return f"""{_signs()},
raw as ({rows}),
firsts as (select side, id, text from (select *, row_number() over (partition by side, id order by ingested_at nulls first, text) as r from raw where id is not null and text is not null) where r = 1),
kept(side, id, text, form) as (select side, id, text, nfc_normalize({kept}) from firsts),
{mapped("kept", "once").strip()},
{mapped("once", "twice").strip()},
forms as (select side, id, text, trim(regexp_replace(form, '\\s+', ' ', 'g')) as form from twice)"""


def _links(across: bool) -> str:
    """CTEs from forms to ``links(a, b, similarity)``: at least 0.6 of the words of either text are in both."""
    sides = "x.side = 0 and y.side = 1" if across else "x.id < y.id"
    return f"""
words as (select distinct side, id, unnest(regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+')) as w from forms),
sizes as (select side, id, count(*) as n from words group by side, id),
shared as (select x.side as sa, y.side as sb, x.id as a, y.id as b, count(*) as k from words x join words y on x.w = y.w and {sides} group by all),
links as (select s.a, s.b, s.k / (p.n + q.n - s.k) as similarity from shared s join sizes p on p.side = s.sa and p.id = s.a join sizes q on q.side = s.sb and q.id = s.b where 10 * s.k >= 6 * (p.n + q.n - s.k))"""


_ONE = "select 0 as side, id, text, ingested_at from kb_hits"
_BOTH = "select 0 as side, id, text, ingested_at from kb_hits union all select 0, id, text, ingested_at from gold_items"
_TRAINING = "lower(trim(kind)) in ('example', 'feedback')"
_SPLITS = f"select 0 as side, id, text, ingested_at from gold_items union all select 1, id, text, ingested_at from kb_hits where {_TRAINING}"
_REACH = """,
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)"""


@lru_cache(maxsize=1)
def oracle_sql() -> dict[str, str]:
    groups, splits, looks = f"with recursive {_forms(_ONE)}, {_links(False)}{_REACH}", f"with {_forms(_SPLITS)}, {_links(True)}", f"with {_forms(_BOTH)}"
    return {
        "p1_found": f"{groups} select distinct a as id_a, b as id_b from reach where a < b",
        "p1_classes": f"""{groups}, rooted as (select s.id, least(s.id, coalesce(min(r.b), s.id)) as class_id from sizes s left join reach r on r.a = s.id group by s.id)
select id, class_id, count(*) over (partition by class_id) as class_size from rooted""",
        "p2_found": f"{splits} select a as item_id, b as hit_id from links",
        "p2_report": f"""{splits},
items as (select id, subset, lower(trim(source)) as source from (select *, row_number() over (partition by id order by ingested_at nulls first, subset nulls first, source nulls first) as r from gold_items where id is not null) where r = 1),
hits as (select id, lower(trim(source)) as hit_source from (select *, row_number() over (partition by id order by ingested_at nulls first, source nulls first) as r from kb_hits where id is not null and {_TRAINING}) where r = 1)
select i.subset, i.source, h.hit_source, count(*) as n_pairs, count(distinct a) as n_items, count(distinct b) as n_hits, sum(cast(similarity >= 1 as bigint)) as n_exact
from links join items i on i.id = a join hits h on h.id = b group by all""",
        "p3_found": f"{looks} select x.id as id_a, y.id as id_b from forms x join forms y on x.form = y.form and x.id < y.id and x.text <> y.text where x.form <> ''",
        "p4_found": _PLAN + "select target_id from plan where available < needed",
        "p4_sample": _PLAN + """, each as (select distinct t.target_id, i.id, ('0x' || substr(md5(i.id || '|7'), 1, 15))::bigint as n from sample_targets t join ids i
    on (t.kind is null or lower(trim(t.kind)) = i.kind) and (t.lang is null or lower(trim(t.lang)) = i.lang) and (t.source is null or lower(trim(t.source)) = i.source))
select target_id, id from (select target_id, id, row_number() over (partition by target_id order by n, id) as r from each) join plan using (target_id) where r <= quota""",
        "p4_report": _PLAN + "select target_id, plan_key, sample_n, available, needed, quota, available >= needed as is_met, quota / nullif(sample_n, 0) as planned_share, quota / nullif(sum(quota) over (partition by plan_key), 0) as achieved_share from plan",
    }
