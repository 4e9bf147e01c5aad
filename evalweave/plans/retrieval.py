"""Queries over search, parsing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.operators import kb as K
from evalweave.operators import parse as P
from evalweave.operators import prompt as T
from evalweave.operators import retrieve as R
from evalweave.operators import run as N
from evalweave.plans import data
from evalweave.plans.data import sql
from evalweave.session import materialise
from evalweave.sources.tables import table

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def _corpus(s, d):
    """All records: definitions and guidelines of any language, examples and feedback by language."""
    by_lang = F.col("kind").isin("example", "feedback")
    k = data.kb(s, d, "kind", "text", "lang").filter("kind in ('definition', 'guideline', 'example', 'feedback') and text is not null")
    return k.filter(~by_lang | F.col("lang").isNotNull()).select(F.when(by_lang, F.concat_ws(":", "kind", "lang")).otherwise(F.col("kind")).alias("bucket"), "id", "text")


def _text_queries(s, d):
    """Items whose number is divisible by 50: the stated query set, against all records."""
    return data.items(s, d, "text").filter((F.regexp_extract("id", "([0-9]+)$", 1) != "") & (F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long") % 50 == 0) & F.col("text").isNotNull()).select(F.col("id").alias("query_id"), "text")


def bm25_stats(s, d):
    sizes, idf = R.bm25_stats(R.term_counts(_corpus(s, d)))
    return idf.groupBy("bucket").agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 4).alias("sum_idf"), F.max("df").alias("max_df")).join(sizes, "bucket").withColumn("avgdl", F.round("avgdl", 6))


def bm25_topk(s, d):
    """Over four kinds of records; an item meets examples and feedback of its own language only."""
    i = data.items(s, d, "lang").select(F.col("id").alias("query_id"), F.lower(F.trim("lang")).alias("lang"))
    q = _text_queries(s, d).join(i, "query_id")
    buckets = F.array_compact(F.array(F.lit("definition"), F.lit("guideline"), *[F.when(F.col("lang").isNotNull(), F.concat(F.lit(f"{k}:"), "lang")) for k in ("example", "feedback")]))
    top = R.bm25_top_k(_corpus(s, d), q.select("query_id", "text", F.explode(buckets).alias("bucket")), 5)
    return top.select("query_id", "bucket", "id", "rank", F.round("score", 5).alias("score"))


def _vectors(s, d):
    return table(s, d, "embeddings", "vec_id", "label", "embedding").select(F.col("label").alias("bucket"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vector_queries(s, d):
    return table(s, d, "embeddings", "vec_id", "embedding").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def dense_topk(s, d):
    return R.dense_top_k(_vectors(s, d), _vector_queries(s, d), 5).select("query_id", "bucket", "id", "rank", F.round("score", 5).alias("score"))


def knn_best_twin(s, d):
    """The nearest record of each query vector, and how many queries each such record is nearest to."""
    one = R.dense_top_k(_vectors(s, d).withColumn("bucket", F.lit(0)), _vector_queries(s, d), 1)
    return one.select("query_id", "id", F.round("score", 5).alias("score"), F.count("*").over(Window.partitionBy("id")).alias("n_queries"))


def cosine_threshold_join(s, d):
    """Query vectors with records of their own label above a threshold."""
    q = _vector_queries(s, d).join(table(s, d, "embeddings", F.col("vec_id").alias("query_id"), F.col("label").alias("bucket")), "query_id")
    return R.dense_near(_vectors(s, d), q, 0.2).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("sim"), 5).alias("best"))


def pairwise_redundancy(s, d):
    hits = R.dense_top_k(_vectors(s, d).withColumn("bucket", F.lit(0)), _vector_queries(s, d), 6).select("query_id", "id").join(table(s, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    return R.redundancy(hits, 0.5).select("query_id", "n_pairs", "n_near", F.round("mean_sim", 5).alias("mean_sim"), F.round("max_sim", 5).alias("max_sim"))


def _documents(s, d):
    return table(s, d, "documents", F.col("doc_id").alias("id"), "text").filter("text is not null").withColumn("bucket", F.lit("all"))


def _stored(s, d):
    """The stored vectors of documents. Not every document has one: the dense channel finds those that have."""
    return table(s, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).withColumn("bucket", F.lit("all"))


def _channels(s, d, depth=10):
    """BM25 over all documents; vectors over all documents that have one. Queries are the documents divisible by 50."""
    c = _documents(s, d)
    q = c.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "text")
    bm = R.bm25_top_k(c, q, depth)
    v = materialise(_stored(s, d).join(c.select("id"), "id", "left_semi"), "document-vectors")  # read for size, queries and search
    de = R.dense_top_k(v, v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), depth)
    cols = ["query_id", "bucket", "id", "rank"]
    return bm.select(*cols, F.lit("bm25").alias("channel")).unionByName(de.select(*cols, F.lit("dense").alias("channel")))


def rrf_fuse(s, d):
    x = R.fuse(_channels(s, d)).filter("rank <= 5")
    return x.select("query_id", "id", "rank", F.round("score", 7).alias("score"), F.coalesce(F.col("ranks")["bm25"], F.lit(0)).alias("bm25_rank"), F.coalesce(F.col("ranks")["dense"], F.lit(0)).alias("dense_rank"))


def retrieve_hybrid(s, d):
    """Fused and diversified: relevance is the cosine to the query, none for a document or a query without a vector."""
    fused = R.fuse(_channels(s, d, 30)).filter("rank <= 30")
    c = _stored(s, d).select("id", "vec")
    q = c.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qv"))
    none = F.array_repeat(F.lit(0.0).cast("float"), 64)
    pool = fused.join(c, "id", "left").join(q, "query_id", "left").withColumn("sim", F.coalesce(R.cosine(F.col("qv"), F.col("vec")), F.lit(0.0))).withColumn("vec", F.coalesce("vec", none))
    return R.diversify(pool, 8)


def mmr_select(s, d):
    pool = R.dense_top_k(_vectors(s, d).withColumn("bucket", F.lit(0)), _vector_queries(s, d), 30)
    pool = pool.join(table(s, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id").withColumnRenamed("score", "sim")
    return R.diversify(pool, 8)


def fewshot_static(s, d):
    k = K.with_meta(data.kb(s, d, "kind", "lang", "meta")).filter("kind = 'example' and not coalesce(meta.illustrative_only, false)")
    return R.static_shots(k, 6)


def _labelled(s, d):
    i = data.items(s, d, "gate", "hate_types").filter("gate and hate_types is not null").select(F.col("id").alias("item_id"), F.col("hate_types").alias("labels"))
    k = K.with_meta(data.kb(s, d, "kind", "meta")).filter("kind = 'example'").select(F.col("id").alias("kb_id"), F.col("meta.hate_types").alias("labels"))
    return i, k.filter("labels is not null")


def oracle_injection(s, d):
    i, k = _labelled(s, d)
    a = R.injected(i, k, True).withColumn("related", F.lit(True))
    return a.unionByName(R.injected(i, k, False).withColumn("related", F.lit(False)))


def retrieved_ids(s, d):
    """Distinct records shown for an item over all its buckets."""
    return data.retrieved(s, d).groupBy("item_id").agg(F.countDistinct("hit_id").alias("n_ids"), F.countDistinct("bucket").alias("n_buckets"), F.count("*").alias("n_hits"))


def channel_shares(s, d):
    return data.retrieved(s, d).groupBy("bucket", "via").agg(F.count("*").alias("n"), F.count(F.when(F.col("score").isNull(), 1)).alias("n_null"), F.round(F.avg("score"), 5).alias("mean_score"))


def parse_accounting(s, d):
    """Predictions read anew from the raw answers."""
    r = P.parse_runs(data.runs(s, d, "raw_outputs"))
    return r.select("run_id", "parse_failure", F.col("hate").cast("string").alias("hate"), F.array_join("legal", ",").alias("legal"), "severity", "repairs", F.md5("reasoning").alias("reasoning"))


def parse_by_arm(s, d):
    r = P.parse_runs(data.runs(s, d, "raw_outputs")).join(data.runs(s, d, "arm"), "run_id")
    return r.groupBy("arm").agg(F.count("*").alias("n"), F.count(F.when(F.col("parse_failure"), 1)).alias("failures"), F.sum("repairs").alias("repairs"), F.count(F.when(F.col("gate_normalised"), 1)).alias("gate_normalised"))


def parse_normalisations(s, d):
    """Repairs of spelling by arm. The log's own count is another: it leaves out keys, so SQL cannot state it."""
    r = P.parse_runs(data.runs(s, d, "raw_outputs")).join(data.runs(s, d, "arm"), "run_id")
    return r.groupBy("arm").agg(F.sum("normalisations").alias("normalisations"), F.count(F.when(F.col("normalisations") > 0, 1)).alias("n_runs"))


def output_inspection(s, d):
    x = data.runs(s, d, "arm", "raw_outputs").select("arm", F.explode("raw_outputs").alias("o")).filter("o is not null")
    return x.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.length("o")), 4).alias("mean_chars"), F.count(F.when(F.lower("o").contains("<think>"), 1)).alias("traces"), F.count(F.when(F.col("o").contains("```"), 1)).alias("fences"))


def mock_run(s, d):
    """A whole run with the mock client: prompts, sampled answers with a repair, vote."""
    ctx = s.createDataFrame([], "item_id string, bucket string, pos int, line string")
    p = T.build_prompts(data.items(s, d, "text").filter("text is not null"), ctx, "Classify the text.", {"examples": "Examples:"}).withColumn("arm", F.lit("zero_shot"))
    v = N.classify(p.select("item_id", "arm", "messages"), lambda: N.MockClient(broken=True), "mock-1", "mock-1")
    return v.groupBy("arm", "hate", "uncertain").agg(F.count("*").alias("n"), F.sum("n_valid").alias("n_valid"))


def prompt_label_space(s, d):
    return s.createDataFrame([(T.label_space(),)], "label_space string")


def prompt_render_gold(s, d):
    return data.items(s, d, "gate", "target_groups", "hate_types", "severity", "legal").select("id", T.render_gold().alias("gold"))


def prompt_sizes(s, d):
    """Characters of the user message by number of hits shown."""
    k = data.kb(s, d, "text")
    c = data.retrieved(s, d).join(k, F.col("hit_id") == k["id"]).filter("text is not null").groupBy("item_id", "bucket", "hit_id").agg(F.min("hit_pos").alias("pos"), F.first("text").alias("line"))
    heads = {"definitions": "Definitions:", "guidelines": "Guidelines:", "examples": "Examples:", "feedback": "Corrections:"}
    p = T.build_prompts(data.items(s, d, "text").filter("text is not null"), c, "Classify the text.", heads)
    return p.select("item_id", F.length(F.col("messages")[1]["text"]).alias("chars"))


_HITS = ", ".join(f"'{x}'" for x in ("definitions", "guidelines", "examples", "feedback"))
_BM = f"""
c as (select case when kind in ('example', 'feedback') then kind || ':' || lang else kind end as bucket, id, text, {_TOK.format('text')} as w from kb
      where kind in ('definition', 'guideline', 'example', 'feedback') and text is not null and (lang is not null or kind in ('definition', 'guideline'))),
sz as (select bucket, count(*) as n, avg(len(w)) as avgdl from c group by bucket),
tf as (select bucket, id, term, count(*) as tf, any_value(dl) as dl from (select bucket, id, len(w) as dl, unnest(w) as term from c) group by bucket, id, term),
dfs as (select bucket, term, count(*) as df, any_value(n) as n from tf join sz using (bucket) group by bucket, term),
rw as (select *, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs),
idf as (select r.bucket, term, df, case when raw < 0 then 0.25 * mean else raw end as idf from rw r join (select bucket, avg(raw) as mean from rw group by bucket) m using (bucket))
"""
_COS = "list_cosine_similarity({}::double[], {}::double[])"
_HC = f"""with c as (select doc_id as id, text, embedding as vec, {_TOK.format('text')} as w from documents left join embeddings on doc_id = vec_id where text is not null),
sz as (select count(*) as n, avg(len(w)) as avgdl from c), tf as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest(w) as term from c) group by id, term),
rw as (select term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, sz group by term), idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from rw) else raw end as idf from rw),
q as (select * from c where id % 50 = 0), qt as (select id as query_id, term, count(*) as qtf from (select id, unnest(w) as term from q) group by all),
bm as (select query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join tf using (term) join idf using (term), sz where query_id <> id group by all),
bk as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from bm) where rank <= 10 and score > 0),
dn as (select q.id as query_id, c.id, {_COS.format('q.vec', 'c.vec')} as score from q join c on q.id <> c.id where q.vec is not null and c.vec is not null),
dk as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from dn) where rank <= 10),
f as (select query_id, id, sum(1.0::double / (60 + rank)) as score, max(rank) filter (where ch = 'b') as bm25_rank, max(rank) filter (where ch = 'd') as dense_rank from (select query_id, id, rank, 'b' as ch from bk union all select query_id, id, rank, 'd' from dk) group by all)
"""
_SHOWN = ("select item_id, bucket, hit_id, min(hit_pos) as pos, any_value(k.text) as line from hits h join kb k on h.hit_id = k.id where k.text is not null and bucket in (" + _HITS + ") group by all")

def _mmr(pool: str, n: int, cos: str) -> str:
    """CTEs and select of ``n`` picks one after the other from ``pool(query_id, id, rank, sim, vec)``."""
    x = f"{pool}, nq as (select query_id, count(*) as n from pool group by query_id), m0 as (select query_id, id, vec, 0 as pick from pool where false)"
    for i in range(1, n + 1):
        value = "p.sim" if i == 1 else f"0.7 * p.sim - 0.3 * (select max({cos.format('p.vec', 'm.vec')}) from m{i - 1} m where m.query_id = p.query_id)"
        if i == 1:
            value = "0.7 * p.sim"
        x += f", m{i} as (select * from m{i - 1} union all select query_id, id, vec, {i} from (select p.*, row_number() over (partition by query_id order by round({value}, 9) desc, rank) as r from pool p join nq using (query_id) where nq.n > {n} and (query_id, id) not in (select (query_id, id) from m{i - 1})) where r = 1)"
    return f"{x} select query_id, id, pick from m{n} union all select query_id, id, row_number() over (partition by query_id order by rank) from pool join nq using (query_id) where nq.n <= {n}"


QUERIES = {
    f.__name__: f
    for f in (bm25_stats, bm25_topk, dense_topk, knn_best_twin, cosine_threshold_join, pairwise_redundancy, rrf_fuse, retrieve_hybrid, mmr_select, fewshot_static, oracle_injection, retrieved_ids, channel_shares, parse_accounting, parse_by_arm, parse_normalisations, output_inspection, mock_run, prompt_label_space, prompt_render_gold, prompt_sizes)
}
_RAWMETA = "try_cast(meta as json)"
ORACLE = {
    "bm25_stats": sql(f", {_BM} select bucket, n_terms, round(s, 4) as sum_idf, max_df, n, round(avgdl, 6) as avgdl from (select bucket, count(*) as n_terms, sum(idf) as s, max(df) as max_df from idf group by bucket) join sz using (bucket)", "kb"),
    "bm25_topk": sql(
        f""", {_BM}, q as (select id as query_id, unnest(list_distinct(['definition', 'guideline', 'example:' || lower(trim(lang)), 'feedback:' || lower(trim(lang))])) as bucket, {_TOK.format('text')} as w from items where text is not null and try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 50 = 0),
        qt as (select query_id, bucket, term, count(*) as qtf from (select query_id, bucket, unnest(w) as term from q) group by all),
        s as (select query_id, tf.bucket, tf.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join tf using (bucket, term) join idf using (bucket, term) join sz using (bucket) group by all)
        select query_id, bucket, id, rank, round(score, 5) as score from (select *, row_number() over (partition by query_id, bucket order by round(score, 6) desc, id) as rank from s) where rank <= 5 and score > 0""",
        "kb", "items",
    ),
    "dense_topk": f"select query_id, bucket, id, rank, round(score, 5) as score from (select *, row_number() over (partition by query_id, bucket order by round(score, 6) desc, id) as rank from (select q.vec_id as query_id, c.label as bucket, c.vec_id as id, {_COS.format('q.embedding', 'c.embedding')} as score from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)) where rank <= 5",
    "knn_best_twin": f"select query_id, id, round(score, 5) as score, count(*) over (partition by id) as n_queries from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from (select q.vec_id as query_id, c.vec_id as id, {_COS.format('q.embedding', 'c.embedding')} as score from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)) where rank = 1",
    "cosine_threshold_join": f"select query_id, count(*) as n, round(max(sim), 5) as best from (select q.vec_id as query_id, {_COS.format('q.embedding', 'c.embedding')} as sim from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 50 = 0) where round(sim, 6) >= 0.2 group by query_id",
    "pairwise_redundancy": f"with t as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from (select q.vec_id as query_id, c.vec_id as id, c.embedding as vec, {_COS.format('q.embedding', 'c.embedding')} as score from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)) where rank <= 6), p as (select a.query_id, {_COS.format('a.vec', 'b.vec')} as sim from t a join t b on a.query_id = b.query_id and a.id < b.id) select query_id, count(*) as n_pairs, count(*) filter (where sim > 0.5) as n_near, round(avg(sim), 5) as mean_sim, round(max(sim), 5) as max_sim from p group by query_id",
    "rrf_fuse": _HC + "select query_id, id, rank, round(score, 7) as score, coalesce(bm25_rank, 0) as bm25_rank, coalesce(dense_rank, 0) as dense_rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 5",
    "fewshot_static": sql(f"select lang, id, pick from (select lang, id, row_number() over (partition by lang order by ('0x' || substr(md5(id || '|0'), 1, 15))::bigint, id) as pick from kb where kind = 'example' and coalesce(json_extract_string({_RAWMETA}, '$.illustrative_only'), 'false') <> 'true') where pick <= 6", "kb"),
    "oracle_injection": sql(
        f""", i as (select id as item_id, hate_types as labels from items where gate and hate_types is not null),
        k as (select id as kb_id, from_json(json_extract({_RAWMETA}, '$.hate_types'), '["VARCHAR"]') as labels, ('0x' || substr(md5(id || '|0'), 1, 15))::bigint as n from kb where kind = 'example'),
        p as (select item_id, kb_id, n, list_has_any(i.labels, k.labels) as related from i join k on k.labels is not null)
        select item_id, kb_id, related from (select *, row_number() over (partition by item_id, related order by n, kb_id) as r from p) where r = 1""",
        "items", "kb",
    ),
    "retrieved_ids": sql("select item_id, count(distinct hit_id) as n_ids, count(distinct bucket) as n_buckets, count(*) as n_hits from hits group by item_id", "hits"),
    "channel_shares": sql("select bucket, via, count(*) as n, count(*) - count(score) as n_null, round(avg(score), 5) as mean_score from hits group by bucket, via", "hits"),
    "parse_accounting": sql("select run_id, parse_failure, hate::varchar as hate, array_to_string(legal, ',') as legal, severity, repairs, md5(reasoning) as reasoning from runs where len(raw_outputs) > 0", "runs"),
    "parse_by_arm": sql("select arm, count(*) as n, count(*) filter (where parse_failure) as failures, sum(repairs)::bigint as repairs, count(*) filter (where gate_normalised) as gate_normalised from runs where len(raw_outputs) > 0 group by arm", "runs"),
    "retrieve_hybrid": _mmr(
        _HC.replace("rank <= 10", "rank <= 30") + f""", fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f),
        pool as (select query_id, fr.id, rank, c.vec, coalesce({_COS.format('qc.vec', 'c.vec')}, 0) as sim from fr join c on c.id = fr.id join c qc on qc.id = query_id where rank <= 30)""",
        8, f"coalesce({_COS}, 0)",
    ),
    "mmr_select": _mmr(f"with s as (select q.vec_id as query_id, c.vec_id as id, c.embedding as vec, {_COS.format('q.embedding', 'c.embedding')} as sim from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0), pool as (select * from (select *, row_number() over (partition by query_id order by round(sim, 6) desc, id) as rank from s) where rank <= 30)", 8, _COS),
    "output_inspection": sql("select arm, count(*) as n, round(avg(length(o)), 4) as mean_chars, count(*) filter (where contains(lower(o), '<think>')) as traces, count(*) filter (where contains(o, '```')) as fences from (select arm, unnest(raw_outputs) as o from runs) where o is not null group by arm", "runs"),
    "prompt_render_gold": sql("select id, concat_ws('; ', case when gate is not null then 'hate: ' || gate::varchar end, " + ", ".join(f"case when {c} is not null then '{n}: ' || case when len({c}) = 0 then 'none' else array_to_string({c}, ', ') end end" if c != "severity" else "case when severity is not null then 'severity: ' || severity end" for n, c in (("target_group", "target_groups"), ("hate_type", "hate_types"), ("severity", "severity"), ("legal", "legal"))) + ") as gold from items", "items"),
    "prompt_sizes": sql(
        f""", sh as ({_SHOWN}), sec as (select item_id, bucket, sum(length(line) + 3) - 1 as body, case bucket when 'definitions' then 12 when 'guidelines' then 11 when 'examples' then 9 else 12 end + 1 as head from sh group by item_id, bucket),
        kn as (select item_id, sum(body + head + 2) as k from sec group by item_id)
        select i.id as item_id, cast(coalesce(k, 0) + 6 + length({r"trim(regexp_replace(text, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"}) as bigint) as chars from items i left join kn on kn.item_id = i.id where i.text is not null""",
        "items", "hits", "kb",
    ),
}
