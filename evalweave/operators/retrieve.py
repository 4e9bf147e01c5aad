"""Search over records: BM25, dense vectors, rank fusion, diversification and budgets.

A query set is stated; filters apply before ranks, so a bucket is part of every ranking's key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions.text import split_words, tokens
from evalweave.operators.sampling import draw_number
from evalweave.session import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: So many terms of queries, 12 bytes each, are sent to all executors at a time; more are sent in further passes. So many
#: numbers of query vectors are sent; more are joined by shuffle.
BROADCAST_TERMS, BROADCAST_NUMBERS = 4_000_000, 8_000_000
#: Terms of records indexed at a time; additions of a term, a record, that cost more than a row of a matrix product with one
#: query; records of a block up to which all are scored; sums held at a time.
POSTINGS, OFTEN, SMALL, SUMS = 3_000_000, 1 / 100, 64, 8_000_000
#: Different sets of labels on one side that are met with those of the other.
MOST_SETS = 10_000
#: Queries scored at a time against a batch of records.
BLOCK = 256


def top_k(scored: DataFrame, by: list[str], k: int, tie: str = "id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each key with their rank; scores equal to six places are ties and go by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_counts(corpus: DataFrame) -> DataFrame:
    """(bucket, id, dl, terms, tfs) of ``corpus(bucket, id, text)``: one row a record, counted where it is read, stored once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (all_, dl) = batch.num_rows, split_words(batch.column(2))
            coded = all_.dictionary_encode()
            words = max(1, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(n), dl) * words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, word = np.divmod(pairs, words)
            start = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            both = [pa.ListArray.from_arrays(start, x) for x in (coded.dictionary.take(pa.array(word)), pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dl, pa.int32()), *both], names=["bucket", "id", "dl", "terms", "tfs"])

    kind = dict(corpus.dtypes)
    t = corpus.filter("text is not null").select("bucket", "id", F.lower("text"))
    return materialise(t.mapInArrow(count, f"bucket {kind['bucket']}, id {kind['id']}, dl int, terms array<string>, tfs array<int>"), "bm25-terms")


def _with_words(df: DataFrame) -> DataFrame:
    """``df`` without ``text`` and with its words ``w``, split as those of the records are."""
    others = [c for c in df.columns if c != "text"]
    kind = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = split_words(batch.column(batch.num_columns - 1))
            w = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], w], names=[*others, "w"])

    return df.select(*others, F.lower("text")).mapInArrow(run, ", ".join([*(f"{c} {kind[c]}" for c in others), "w array<string>"]))


def bm25_stats(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, n, avgdl) and (bucket, term, df, idf) of ``term_counts``. Negative idf becomes EPSILON times the bucket's mean idf."""
    sizes = counted.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = materialise(counted.select("bucket", F.explode("terms").alias("term")).groupBy("bucket", "term").agg(F.count("*").alias("df")), "bm25-df").join(sizes.select("bucket", "n"), "bucket")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("bucket").agg(F.avg("raw").alias("mean"))
    idf = raw.join(mean, "bucket").select("bucket", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return sizes, idf


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, bucket, id, score, rank) of the ``k`` best records of each bucket for ``queries(query_id, text)``.

    Repeated query terms count repeatedly; queries that have a ``bucket`` search that one only; a record with the query's own
    id is no hit. The cut to ``k`` comes first and scores that are not positive are dropped after, so fewer may remain.

    The queries' terms go to the records as numbers, BROADCAST_TERMS at a time; each task indexes its records block by block
    and hands on only the best of all its blocks.
    """
    counted = term_counts(corpus)
    sizes, idf = bm25_stats(counted)
    q = _with_words(queries.filter("text is not null and query_id is not null").select("query_id", *(["bucket"] if "bucket" in queries.columns else []), "text"))
    if "bucket" in queries.columns:
        q = q.groupBy("query_id", "bucket").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w")).groupBy("query_id", "w").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    else:
        q = q.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w")).withColumn("buckets", F.lit(None).cast(f"array<{dict(counted.dtypes)['bucket']}>"))
    q = materialise(q.filter(F.size("w") > 0), "bm25-queries")
    known = materialise(idf.join(q.select(F.explode("w").alias("term")).distinct(), "term", "left_semi").join(sizes, "bucket").select("bucket", "term", "idf", "avgdl"), "bm25-weights")
    passes = max(1, -(-(q.agg(F.sum(F.size("w"))).first()[0] or 0) // BROADCAST_TERMS))
    found = None
    for n in range(passes):
        mine = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n) if passes > 1 else q
        here = _scored_here(counted, mine, known, k)
        found = here if found is None else found.unionByName(here)
    return top_k(found, ["query_id", "bucket"], k).filter("score > 0")


def _scored_here(counted: DataFrame, queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(query_id, bucket, id, score): of the records of every task the best of each of ``queries(query_id, w, buckets)``, ties
    at the cut included; ``known(bucket, term, idf, avgdl)`` has the queries' terms."""
    asked, table = queries.toArrow(), known.toArrow()
    words = pc.unique(table["term"])
    per: dict = {}
    of_bucket, term, idf, avgdl = table["bucket"].combine_chunks().dictionary_encode(), pc.index_in(table["term"], value_set=words).to_numpy(), table["idf"].to_numpy(), table["avgdl"].to_numpy()
    for code, bucket in enumerate(of_bucket.dictionary.to_pylist()):
        mine = np.flatnonzero(of_bucket.indices.to_numpy(zero_copy_only=False) == code)
        weight = np.zeros(len(words))
        weight[term[mine]] = idf[mine]
        per[bucket] = (weight, float(avgdl[mine[0]]))
    lists = asked["w"].combine_chunks()
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy(zero_copy_only=False))[at >= 0]
    pairs, qtf = np.unique(row * max(1, len(words)) + at[at >= 0], return_counts=True)
    row, at = np.divmod(pairs, max(1, len(words)))
    names, wanted = asked["query_id"].to_numpy(), asked["buckets"].combine_chunks()
    open_to_all = np.flatnonzero(wanted.is_null().to_numpy(zero_copy_only=False))
    each = pd.DataFrame({"row": np.repeat(np.arange(len(asked)), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), "bucket": wanted.flatten().to_pylist()}).groupby("bucket")["row"]
    rows_of = {b: r.to_numpy() for b, r in each}
    start = np.searchsorted(row, np.arange(len(asked) + 1))
    turn = np.argsort(_alike(start, at, len(words)))
    asking = {b: (x := np.concatenate([open_to_all, rows_of.get(b, open_to_all[:0])]))[np.argsort(turn[x])] for b in per}
    shared = counted.sparkSession.sparkContext.broadcast((words, per, names, start, at.astype(np.int32), qtf.astype(np.int32), asking))
    fields = _hit_fields(dict(queries.dtypes)["query_id"], dict(counted.dtypes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, per, names, start, at, qtf, asking = shared.value
        held: dict = {b: [] for b in per}
        best: dict = {b: {} for b in per}

        def meet(bucket) -> None:
            if held[bucket]:
                ids, dl, sizes, term, tf = (np.concatenate(x) for x in zip(*held[bucket]))
                held[bucket] = []
                weight, avgdl = per[bucket]
                _Index(ids, dl, sizes, term, tf, avgdl, len(words)).search(weight, names, asking[bucket], start, at, qtf, k, best[bucket])

        for batch in batches:
            n, lists = batch.num_rows, batch.column(3)
            if not n or not len(words):
                continue
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
            tf, row = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            term, tf, row = term[term >= 0], tf[term >= 0], row[term >= 0]
            sizes, ids, dl = np.bincount(row, minlength=n), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            coded = batch.column(0).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            for c, bucket in enumerate(coded.dictionary.to_pylist()):
                mine, these = (code == c) & (sizes > 0), code[row] == c
                if bucket in per and len(asking[bucket]) and mine.any():
                    held[bucket].append((ids[mine], dl[mine], sizes[mine], term[these], tf[these]))
                    if sum(len(x[3]) for x in held[bucket]) >= POSTINGS:
                        meet(bucket)
        for bucket in per:
            meet(bucket)
            yield from _batches(best.pop(bucket), names, bucket, fields)

    # few tasks, as each hands on its best of every query
    return counted.filter("id is not null").coalesce(3 * counted.sparkSession.sparkContext.defaultParallelism).mapInArrow(search, fields)


def _batches(best: dict, names: np.ndarray, bucket, fields: str, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The (scores, ids) that ``best`` has by query number, as rows."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    q, b, d, _ = (kinds[f.split()[1]] for f in fields.replace("double", "string").split(", "))
    some = [i for i, x in best.items() if len(x[0])]
    step = max(1, rows // max(1, max((len(best[i][0]) for i in some), default=1)))
    for s in range(0, len(some), step):
        part = some[s : s + step]
        score, ids = (np.concatenate([best[i][j] for i in part]) for j in (0, 1))
        of = np.repeat(np.array(part), [len(best[i][0]) for i in part])
        yield pa.RecordBatch.from_arrays([pa.array(names[of], q), pa.array([bucket] * len(of), b), pa.array(ids, d), pa.array(score)], names=["query_id", "bucket", "id", "score"])


def _keep(best: dict, i: int, score: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Add to what ``best`` has of query ``i``: (scores, ids, least score of interest), the ``k`` best and ties with the last."""
    if i in best:
        score, ids = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], ids])
    least = -np.inf
    if len(score) >= k:
        least = np.partition(score, len(score) - k)[len(score) - k] - 2e-6
        score, ids = score[score >= least], ids[score >= least]
    best[i] = (score, ids, least)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and where each range begins among them."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum())), first


def _alike(start: np.ndarray, at: np.ndarray, n_terms: int, groups: int = 48) -> np.ndarray:
    """The numbers of the queries, those with like terms next to each other: by the nearest of some centres, over the terms
    that most have but not half."""
    n = len(start) - 1
    have = np.bincount(at, minlength=n_terms)
    common = np.flatnonzero((have > 0) & (have < n / 2))
    common = common[np.argsort(-have[common], kind="stable")][:256]
    if n < 512 or not len(common):
        return np.arange(n)
    place, weight = np.full(n_terms, -1), np.log(n / have[common])

    def some(rows: np.ndarray) -> np.ndarray:
        m, size = np.zeros((len(rows), len(common)), np.float32), start[rows + 1] - start[rows]
        p, r = place[at[_ranges(start[rows], size)[0]]], np.repeat(np.arange(len(rows)), size)
        m[r[p >= 0], p[p >= 0]] = weight[p[p >= 0]]
        return m

    place[common] = np.arange(len(common))
    m = _unit(some(np.linspace(0, n - 1, min(n, 4096)).astype(int)))
    centres = m[np.linspace(0, len(m) - 1, groups).astype(int)]
    for _ in range(6):
        near = np.argmax(m @ centres.T, axis=1)
        centres = _unit(np.stack([m[near == g].sum(axis=0) for g in range(groups)]))
    near = [np.argmax(some(rows) @ centres.T, axis=1) for rows in np.array_split(np.arange(n), -(-n // 4096))]
    return np.argsort(np.concatenate(near), kind="stable")


class _Index:
    """A block of records, by record and by term.

    Queries come some at a time. Terms that many of them have and many records are met as matrix products of single precision,
    the others are added for all their records. Records whose sum may be among the best, by what the sums can be off, are
    scored exactly, so the best are those that adding up everything would give.
    """

    def __init__(self, ids: np.ndarray, dl: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, avgdl: float, n_terms: int) -> None:
        self.ids, self.n, self.times = ids, len(ids), Counter(ids.tolist())
        rec = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(rec * n_terms + term)
        self.term = term[order].astype(np.int64)
        tf = tf[order].astype(np.float64)
        self.grown = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[rec] / avgdl))
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        order = np.argsort(self.term, kind="stable")
        self.p_rec, self.p_grown = rec[order], self.grown[order].astype(np.float32)
        self.count = np.bincount(self.term, minlength=n_terms)
        self.p_start = np.cumsum(self.count) - self.count
        self.place, self.dense = np.full(n_terms, -1), np.zeros((0, self.n), np.float32)

    def _rows(self, t: np.ndarray, queries: int) -> np.ndarray:
        """The rows of a product for the terms ``t`` of so many queries, where that is less work than to add each by itself."""
        times = np.bincount(t, minlength=len(self.count)) * self.count
        often = np.flatnonzero(times >= max(1, OFTEN * (queries + 16) * self.n))
        often = often[np.argsort(-times[often])][: max(0, 2 * SUMS // self.n)]
        self.place[:] = -1
        self.place[often] = np.arange(len(often))
        if len(often) > len(self.dense):
            self.dense = np.empty((len(often), self.n), np.float32)
        rows = self.dense[: len(often)]
        rows[:] = 0
        for row, a, z in zip(rows, self.p_start[often].tolist(), (self.p_start[often] + self.count[often]).tolist()):
            row[self.p_rec[a:z]] = self.p_grown[a:z]
        return rows

    def exact(self, recs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for s in range(0, len(recs), 8192):
            at, first = _ranges(self.start[recs[s : s + 8192]], self.size[recs[s : s + 8192]])
            out.append(np.add.reduceat(weight[self.term[at]] * self.grown[at], first))
        return np.concatenate(out)

    def search(self, idf: np.ndarray, names: np.ndarray, asking: np.ndarray, start: np.ndarray, at: np.ndarray, qtf: np.ndarray, k: int, best: dict) -> None:
        weight = np.zeros(len(idf))
        every = np.arange(self.n)
        step = max(16, min(256, SUMS // self.n))
        room = np.empty((min(step, len(asking)), self.n if self.n > SMALL else 0), np.float32)
        for low in range(0, len(asking), step):
            block = asking[low : low + step]
            size = start[block + 1] - start[block]
            here, first = _ranges(start[block], size)
            t = at[here].astype(np.int64)
            w, j, sums = qtf[here] * idf[t], np.repeat(np.arange(len(block)), size), None
            if self.n > SMALL:
                rows = self._rows(t, len(block))
                p = self.place[t]
                front = np.zeros((len(block), len(rows)), np.float32)
                front[j[p >= 0], p[p >= 0]] = w[p >= 0]
                sums = np.matmul(front, rows, out=room[: len(block)])
            p = self.place[t]
            met, rare = self.count[t] > 0, (p < 0) & (self.count[t] > 0)
            # no grown count is above K1 + 1
            slack = 6e-8 * (size + 8) * np.bincount(j, np.abs(w) * met, len(block)) * (K1 + 1) + 2e-6
            some, few = np.bincount(j, met, len(block)), np.bincount(j, rare, len(block)).astype(int)
            last, lightest = np.cumsum(few), np.full(len(block), np.inf)
            np.minimum.at(lightest, j, w)
            few_t, few_w = t[rare], w[rare].astype(np.float32)
            for j in np.flatnonzero(some):
                i, mine = block[j], slice(first[j], first[j] + size[j])
                least = best[i][2] if i in best else -np.inf
                if sums is None:
                    recs = every
                else:
                    self._add(sums[j], few_t[last[j] - few[j] : last[j]], few_w[last[j] - few[j] : last[j]])
                    low_sum = max(least, 0, self._reached(sums[j], k + self.times[names[i]]) - slack[j]) - slack[j]
                    # sums of positive numbers only are 0 where nothing is met
                    recs = np.flatnonzero(sums[j] > (max(low_sum, 0) if lightest[j] > 0 else low_sum))
                weight[t[mine]] = w[mine]
                score = self.exact(recs, weight)
                weight[t[mine]] = 0
                ok = (score > 0) & (score >= least) & (self.ids[recs] != names[i])
                if ok.any():
                    _keep(best, i, score[ok], self.ids[recs[ok]], k)

    def _add(self, sums: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        if len(t):
            count, first = self.count[t], self.p_start[t]
            parts = [slice(a, z) for a, z in zip(first.tolist(), (first + count).tolist())]
            np.add.at(sums, np.concatenate([self.p_rec[x] for x in parts]), np.concatenate([self.p_grown[x] for x in parts]) * np.repeat(w, count))

    def _reached(self, sums: np.ndarray, m: int) -> float:
        """What ``m`` records reach at least: by the best of groups, as there are fewer of them."""
        groups = self.n // 16 if self.n >= 256 * m else self.n
        if groups < m:
            return -np.inf
        top = sums[: groups * (self.n // groups)].reshape(-1, groups).max(axis=0)
        return float(np.partition(top, groups - m)[groups - m])


def _hit_fields(query: str, kind: dict[str, str]) -> str:
    return f"query_id {query}, bucket {kind['bucket']}, id {kind['id']}, score double"


def _best(score: np.ndarray, met: np.ndarray, names: list, bucket, ids: np.ndarray, k: int, fields: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each row of ``score`` where ``met``, and what ties with the last of them. No name meets itself."""
    rows, cols = [], []
    for i, name in enumerate(names):
        at = np.flatnonzero(met[i] & (ids != name))
        if len(at) > k:
            cut = np.partition(score[i, at], len(at) - k)[len(at) - k]
            at = at[score[i, at] >= cut - 2e-6]
        rows.append(np.full(len(at), i))
        cols.append(at)
    r, c = np.concatenate(rows), np.concatenate(cols)
    if len(r):
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        q, b, d, _ = (kinds[f.split()[1]] for f in fields.replace("double", "string").split(", "))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[r], q), pa.array([bucket] * len(r), b), pa.array(ids[c], d), pa.array(score[r, c])], names=["query_id", "bucket", "id", "score"])


def dense_scored(corpus: DataFrame, queries: DataFrame, k: int, batch: int = 2048, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, bucket, id, score): of every task's part of ``corpus(bucket, id, vec)`` the ``k`` nearest to each of
    ``queries(query_id, vec)`` by cosine, exactly, ties at the cut included. ``wanted(query_id, bucket)`` names the buckets
    that each query searches, all if not given.

    The corpus streams through; query vectors up to BROADCAST_NUMBERS numbers are sent to all executors and meet each batch
    as a matrix product. More are cut into blocks that the corpus meets one after the other, each a shuffled tile.
    """
    q = queries.filter("vec is not null").select("query_id", "vec")
    n, dims = q.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    c = corpus.filter("vec is not null").select("bucket", "id", "vec")
    kind = dict(c.dtypes)
    fields = _hit_fields(dict(q.dtypes)["query_id"], kind)

    def meet(names: list, m: np.ndarray, pdf: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(pdf), batch):
            part = pdf.iloc[start : start + batch]
            v = _unit(np.stack(part["vec"].to_numpy()))
            for bucket in part["bucket"].unique():
                at = np.flatnonzero(part["bucket"].to_numpy() == bucket)
                for low in range(0, len(names), BLOCK):
                    score = np.round(m[low : low + BLOCK] @ v[at].T, 12)
                    yield from _best(score, np.ones(score.shape, bool), names[low : low + BLOCK], bucket, part["id"].to_numpy()[at], k, fields)

    if n * dims <= BROADCAST_NUMBERS:
        rows = q.toPandas()
        asking = None if wanted is None else wanted.join(q.select("query_id"), "query_id", "left_semi").toPandas().drop_duplicates()
        if asking is not None:
            of = {name: i for i, name in enumerate(rows["query_id"])}
            asking = {bucket: np.sort(x.map(of).to_numpy()) for bucket, x in asking.groupby("bucket")["query_id"]}
        shared = corpus.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(np.stack(rows["vec"].to_numpy())) if len(rows) else np.zeros((0, 1)), asking))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m, asking = shared.value
            best: dict = {}
            for b in batches:
                if not len(names) or not b.num_rows:
                    continue
                vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ids, coded = b.column(1).to_numpy(zero_copy_only=False), b.column(0).dictionary_encode()
                code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                for c, bucket in enumerate(coded.dictionary.to_pylist()):
                    if asking is not None and bucket not in asking:
                        continue
                    if bucket not in best:
                        mine = np.arange(len(names)) if asking is None else asking[bucket]
                        best[bucket] = _Nearest(names[mine], m[mine], k)
                    at = np.flatnonzero(code == c)
                    for s in range(0, len(at), 4 * batch):
                        part = at[s : s + 4 * batch]
                        best[bucket].add(_unit(vectors[part]), ids[part])
            for bucket in list(best):
                x = best.pop(bucket)
                yield from _batches(x.by_query(), x.names, bucket, fields)

        # few tasks, as each hands on its best of every query
        return c.coalesce(3 * corpus.sparkSession.sparkContext.defaultParallelism).mapInArrow(stream, fields)
    blocks, parts = -(-n * dims // BROADCAST_NUMBERS), int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both sides may come from one table, so the vectors get another name
    qb = q.select("query_id", F.col("vec").alias("query_vec")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cb = c.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [x.to_pandas() for x in meet(list(right["query_id"]), _unit(np.stack(right["query_vec"].to_numpy())), left)] if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame(columns=["query_id", "bucket", "id", "score"])

    return cb.groupBy("block", "part").cogroup(qb.groupBy("block", "part")).applyInPandas(tile, fields)


class _Nearest:
    """The nearest records of each query so far, ties at the cut included."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.names, self.vectors, self.k = names, vectors, k
        self.query, self.score, self.ids = np.zeros(0, int), np.zeros(0), None
        self.least = np.full(len(names), -np.inf)

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        found, n = [], len(ids)
        for low in range(0, len(self.names), BLOCK):
            score, least = self.vectors[low : low + BLOCK] @ vectors.T, self.least[low : low + BLOCK]
            if n > self.k + 1 and np.isneginf(least).any():  # one more than asked, as one may be the query itself
                least = np.maximum(least, np.partition(score, n - self.k - 1, axis=1)[:, n - self.k - 1] - 2e-6)
            i, j = np.nonzero(score >= least[:, None])
            found.append((i + low, score[i, j], j))
        query, score, at = (np.concatenate(x) for x in zip(*found))
        other = self.names[query] != ids[at]
        self.query, self.score = np.append(self.query, query[other]), np.append(self.score, np.round(score[other], 12))
        self.ids = ids[at[other]] if self.ids is None else np.append(self.ids, ids[at[other]])
        order = np.lexsort((-self.score, self.query))
        self.query, self.score, self.ids = self.query[order], self.score[order], self.ids[order]
        first = np.searchsorted(self.query, np.arange(len(self.names) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = self.score[first[full] + self.k - 1] - 2e-6
        keep = self.score >= self.least[self.query]
        self.query, self.score, self.ids = self.query[keep], self.score[keep], self.ids[keep]

    def by_query(self) -> dict:
        first = np.searchsorted(self.query, np.arange(len(self.names) + 1))
        return {i: (self.score[a:z], self.ids[a:z]) for i, (a, z) in enumerate(zip(first, first[1:])) if z > a}


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, bucket, id, score, rank): the exact cosine top-k within each bucket, or each that is ``wanted(query_id,
    bucket)``. A record never meets itself."""
    found = dense_scored(corpus, queries, k, wanted=wanted)
    return top_k(found if wanted is None else found.join(wanted, ["query_id", "bucket"], "left_semi"), ["query_id", "bucket"], k)


def dense_near(corpus: DataFrame, queries: DataFrame, least: float, batch: int = 2048) -> DataFrame:
    """(query_id, id, sim) of all records of a query's own bucket whose cosine to it is ``least`` or more at six places.

    ``corpus(bucket, id, vec)`` streams past ``queries(query_id, bucket, vec)`` of a checked size as matrix products.
    """
    q = queries.filter("vec is not null").select("query_id", "bucket", "vec")
    n, dims = q.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    c = corpus.filter("vec is not null").select("bucket", "id", "vec")
    kind = dict(c.dtypes)
    if n * dims > BROADCAST_NUMBERS:  # by bucket, pair by pair
        j = c.join(q.withColumnRenamed("vec", "qv"), "bucket").filter("id <> query_id").withColumn("sim", cosine(F.col("qv"), F.col("vec")))
        return j.filter(F.round("sim", 6) >= least).select("query_id", "id", "sim")
    asked = {b: (g["query_id"].to_numpy(), _unit(np.stack(g["vec"].to_numpy()))) for b, g in q.toPandas().groupby("bucket")}
    shared = corpus.sparkSession.sparkContext.broadcast(asked)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, part in b.to_pandas().groupby("bucket"):
                if bucket in shared.value:
                    names, m = shared.value[bucket]
                    ids = part["id"].to_numpy()
                    for s in range(0, len(part), batch):
                        score = np.round(m @ _unit(np.stack(part["vec"].to_numpy()[s : s + batch])).T, 12)
                        i, j = np.nonzero(np.round(score, 6) >= least)
                        keep = names[i] != ids[s : s + batch][j]
                        i, j = i[keep], j[keep]
                        yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": names[i], "id": ids[s : s + batch][j], "sim": score[i, j]}), preserve_index=False)

    return c.mapInArrow(stream, f"query_id {dict(q.dtypes)['query_id']}, id {kind['id']}, sim double")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fuse(channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, bucket, id, score, rank, ranks) of ``channels(query_id, bucket, id, channel, rank)`` by summed reciprocal ranks."""
    s = channels.groupBy("query_id", "bucket", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))
    w = Window.partitionBy("query_id", "bucket").orderBy(F.desc(F.round("score", 9)), "id")
    return s.withColumn("rank", F.row_number().over(w))


def diversify(pool: DataFrame, top_n: int, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within ``pool(query_id, id, rank, sim, vec)``: relevance against likeness to what is chosen.

    Sequential by nature and bounded by the pool, so it runs by query, over sorted rows. A pool of ``top_n`` or fewer is
    returned as it is.
    """

    def choose(vec: np.ndarray, rel: np.ndarray) -> np.ndarray:
        if len(rel) <= top_n:
            return np.arange(len(rel))
        m, like, order, left = _unit(vec.reshape(len(rel), -1)), np.zeros(len(rel)), [], np.ones(len(rel), bool)
        for _ in range(top_n):
            value = np.where(left, balance * rel - (1 - balance) * like, -np.inf)
            i = int(np.argmax(value))
            order.append(i)
            left[i] = False
            like = np.maximum(like, m @ m[i]) if len(order) > 1 else m @ m[i]
        return np.array(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a query that may go on in the next batch
        for batch in batches:
            held = yield from picked(pa.concat_batches([held, batch]) if held is not None else batch, False)
        if held is not None:
            yield from picked(held, True)

    def picked(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        query = rows.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        ends = np.append(starts[1:], rows.num_rows) if last else starts[1:]
        rel, vec = rows.column(2).to_numpy(zero_copy_only=False).astype(float), rows.column(3)
        at = [a + choose(vec.slice(a, z - a).flatten().to_numpy(zero_copy_only=False), rel[a:z]) for a, z in zip(starts, ends)]
        if at:
            pick = np.concatenate([np.arange(1, len(x) + 1) for x in at])
            both = rows.select([0, 1]).take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*both.columns, pa.array(pick, pa.int32())], names=["query_id", "id", "pick"])
        return None if last or not len(starts) else rows.slice(starts[-1])

    kind = dict(pool.dtypes)
    by_query = pool.select("query_id", "id", "sim", "vec", "rank").repartition("query_id").sortWithinPartitions("query_id", "rank")
    return by_query.mapInArrow(run, f"query_id {kind['query_id']}, id {kind['id']}, pick int")


def definition_budget(definitions: DataFrame, rate: float = 0.3, mode: str = "proportional", flat: int = 2, each: int = 1) -> DataFrame:
    """(dimension, n, budget) of definitions: slots in all (``flat``, one row without dimension), as many for every dimension
    (``per_dimension``), or the rounded share of its definitions, half to even and one at least (``proportional``)."""
    n = definitions.groupBy("dimension").agg(F.count("*").alias("n"))
    if mode == "flat":
        return n.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("dimension"), "n", F.lit(flat).cast("long").alias("budget"))
    if mode == "per_dimension":
        return n.withColumn("budget", F.lit(each).cast("long"))
    if mode != "proportional":
        raise ValueError(f"unknown mode {mode}")
    return n.withColumn("budget", F.greatest(F.lit(1), F.bround(F.col("n") * rate, 0).cast("long")))


#: What a retrieval call may be told; a budget of 0 leaves a bucket out.
BUDGETS = {"strategy": "hybrid", "definitions_mode": "flat", "definitions": 2, "definitions_each": 1, "definitions_rate": 0.3, "guidelines": 2, "examples": 5, "feedback": 1, "depth": 10, "use_mmr": False, "mmr_balance": 0.7, "mmr_pool": 3, "rrf_k": RRF_K}
_DIMENSION_ORDER = ("hate", "target_group", "hate_type", "severity", "legal")


def retrieve(records: DataFrame, queries: DataFrame, cfg: dict) -> DataFrame:
    """(query_id, bucket, id, pos, ranks): a whole retrieval call for every query.

    ``records(id, kind, dimension, lang, text[, vec])``, ``queries(query_id, lang, text[, vec])``. Each bucket (definitions,
    in one or by dimension, guidelines, examples and feedback of the query's language) is searched by itself by the
    strategy, bm25, dense or hybrid, and cut to its budget. With use_mmr a wider dense pool of examples is diversified first.
    Definitions come in the order of the dimensions. A bucket without budget is not searched.
    """
    strategy = cfg["strategy"]
    if strategy not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown strategy {strategy}")
    by_dim, kind = cfg["definitions_mode"] != "flat", F.col("kind")
    records = materialise(records.select("id", "kind", "dimension", "lang", "text", *(["vec"] if strategy != "bm25" else [])), "records")  # read for buckets, budgets and search
    name = F.when(kind == "definition", F.concat(F.lit("definition:"), F.col("dimension")) if by_dim else F.lit("definition")).when(kind == "guideline", "guideline").when(kind.isin("example", "feedback"), F.concat_ws(":", "kind", F.col("lang")))
    named = records.filter(F.when(kind.isin("example", "feedback"), F.col("lang").isNotNull()).otherwise(True)).withColumn("bucket", name).filter("bucket is not null")
    defs = definition_budget(records.filter(kind == "definition"), cfg["definitions_rate"], cfg["definitions_mode"], cfg["definitions"], cfg["definitions_each"]) if by_dim else None
    # a row a bucket: kinds, dimensions and languages
    other = named.filter(kind != "definition").select("bucket").distinct().withColumn("k", F.when(F.col("bucket") == "guideline", cfg["guidelines"]).when(F.col("bucket").startswith("example:"), cfg["examples"]).otherwise(cfg["feedback"]).cast("long"))
    budget = other.unionByName(defs.filter("dimension is not null").select(F.concat(F.lit("definition:"), "dimension").alias("bucket"), F.col("budget").alias("k")) if by_dim else named.filter(kind == "definition").select("bucket").distinct().withColumn("k", F.lit(cfg["definitions"]).cast("long"))).filter("k > 0")
    budget = materialise(budget, "budgets")
    asked = queries.join(F.broadcast(budget), F.when(F.col("bucket").rlike("^(example|feedback):"), F.element_at(F.split("bucket", ":"), 2) == F.col("lang")).otherwise(True)).select(*queries.columns, "bucket", "k")
    asked, found, most = materialise(asked, "asked"), [], {"bm25": 1_000_000, "dense": 1_000_000, "hybrid": cfg["depth"]}
    deep = budget.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0]
    depth = min(most[strategy], int(deep)) if strategy != "hybrid" else cfg["depth"]
    c = named.join(F.broadcast(budget.select("bucket")), "bucket", "left_semi")
    if strategy in ("bm25", "hybrid"):
        found.append(bm25_top_k(c.select("bucket", "id", "text"), asked.select("query_id", "bucket", "text"), depth).select("query_id", "bucket", "id", "rank", F.lit("bm25").alias("channel")))
    if strategy in ("dense", "hybrid"):
        wide = depth * cfg["mmr_pool"] if cfg["use_mmr"] else depth
        v = materialise(c.select("bucket", "id", "vec"), "vectors")  # read to search and to diversify
        near = dense_top_k(v, queries.select("query_id", "vec"), wide, asked.select("query_id", "bucket"))
        is_example = F.col("bucket").startswith("example:")
        if cfg["use_mmr"]:
            pool = near.filter(is_example).withColumnRenamed("score", "sim").join(v, ["bucket", "id"])
            chosen = diversify(pool, depth, cfg["mmr_balance"]).join(asked.filter(is_example).select("query_id", "bucket"), "query_id").select("query_id", "bucket", "id", F.col("pick").alias("rank"))
            near = near.filter(~is_example).select("query_id", "bucket", "id", "rank").unionByName(chosen)
        found.append(near.filter(F.col("rank") <= depth).select("query_id", "bucket", "id", "rank", F.lit("dense").alias("channel")))
    if strategy == "hybrid":
        hits = fuse(found[0].unionByName(found[1]), cfg["rrf_k"])
    else:
        hits = found[0].withColumn("ranks", F.create_map("channel", "rank"))
    hits = hits.join(F.broadcast(budget), "bucket").filter(F.col("rank") <= F.col("k"))
    part = F.when(F.col("bucket").startswith("definition"), "definitions").when(F.col("bucket") == "guideline", "guidelines").when(F.col("bucket").startswith("example"), "examples").otherwise("feedback")
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in _DIMENSION_ORDER]), F.regexp_extract("bucket", "^definition:(.*)$", 1)), F.lit(0))
    w = Window.partitionBy("query_id", "part").orderBy("place", "rank")
    return hits.select("query_id", part.alias("part"), place.alias("place"), "id", "rank", "ranks").withColumn("pos", F.row_number().over(w)).select("query_id", F.col("part").alias("bucket"), "id", "pos", "ranks")


def arm_contexts(items: DataFrame, shots: DataFrame, shown: DataFrame) -> DataFrame:
    """(arm, item_id, bucket, id): what each arm's prompt is given. Without context an item has one row without a record; the
    static arm has the ``shots(lang, id)`` of its language; the other has what was retrieved, ``shown(item_id, bucket, hit_id)``."""
    none = items.select(F.lit("zero_shot").alias("arm"), "item_id", F.lit("none").alias("bucket"), F.lit(None).cast("string").alias("id"))
    few = items.join(F.broadcast(shots.select("lang", "id")), "lang").select(F.lit("few_shot").alias("arm"), "item_id", F.lit("examples").alias("bucket"), "id")  # a few rows a language
    rag = shown.select(F.lit("rag").alias("arm"), "item_id", "bucket", F.col("hit_id").alias("id")).distinct()
    return none.unionByName(few).unionByName(rag)


def static_shots(examples: DataFrame, per_lang: int, seed: int = 0) -> DataFrame:
    """(lang, id, pick): the same few examples of a language for every item, by keyed hash."""
    w = Window.partitionBy("lang").orderBy(draw_number(F.col("id"), seed), "id")
    return examples.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per_lang).select("lang", "id", "pick")


def injected(items: DataFrame, examples: DataFrame, related: bool, seed: int = 0) -> DataFrame:
    """(item_id, kb_id): for each item the first example in hash order whose labels do (or do not) meet the item's.

    ``items(item_id, labels)`` and ``examples(kb_id, labels)`` meet as distinct label sets, of which there are few, each
    represented by its first example; never row by row.
    """
    sets = lambda df: df.withColumn("key", F.array_join(F.array_sort(F.array_distinct("labels")), ","))
    i, e = sets(items.filter("labels is not null")), sets(examples.filter("labels is not null"))
    n = draw_number(F.col("kb_id"), seed)
    first = e.groupBy(F.col("key").alias("e_key")).agg(F.min(F.struct(n.alias("n"), "kb_id")).alias("b"), F.first("labels").alias("e_labels"))
    asked = i.groupBy("key").agg(F.first("labels").alias("labels"))
    for side in (asked, first):
        if side.limit(MOST_SETS + 1).count() > MOST_SETS:
            raise ValueError(f"more than {MOST_SETS} different label sets")
    meets = F.arrays_overlap("labels", "e_labels")
    best = asked.join(first, meets if related else ~F.coalesce(meets, F.lit(False))).groupBy("key").agg(F.min("b").alias("b"))
    return i.join(best, "key").select("item_id", F.col("b.kb_id").alias("kb_id"))


def redundancy(hits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(query_id, n_pairs, n_near, mean_sim, max_sim) of ``hits(query_id, id, vec)``: lists are short, pairs within one only."""
    a = hits.select("query_id", F.col("id").alias("ia"), F.col("vec").alias("va"))
    b = hits.select("query_id", F.col("id").alias("ib"), F.col("vec").alias("vb"))
    p = a.join(b, "query_id").filter("ia < ib").withColumn("sim", cosine(F.col("va"), F.col("vb")))
    return p.groupBy("query_id").agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("sim") > threshold, 1)).alias("n_near"), F.avg("sim").alias("mean_sim"), F.max("sim").alias("max_sim"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hashed_vectors(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """``df`` with ``vec``: unit vector of signed token hashes, where no model and no stored vectors are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes = batch.num_rows, batch.column(batch.num_columns - 1)
            h, row = hashes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            rows = np.bincount(row * dims + h % dims, np.where((h >> 20) & 1, 1.0, -1.0), minlength=n * dims).reshape(n, dims)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(_unit(rows).astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vec], names=[*batch.schema.names[:-1], "vec"])

    x = df.withColumn("vec", F.transform(tokens(text), lambda t: F.xxhash64(t)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vec array<float>"
    return x.mapInArrow(run, fields)
