"""Problem 8: the subject areas of each document.

Method: labelling functions vote on every sentence: two halves of a lexicon, the section around the sentence, the
addresses in the document (links, mail hosts, hashtags) and its source. A latent model learns from the pattern counts of
all sentences how far each function can be trusted, without labels. A document has the areas whose expected number of
sentences by the posterior, in whole sentences, is at least ``share`` of its sentences.

Text is cut once; words are kept as 64-bit hashes, distinct within their sentence, and all later passes work on arrays.

The lexicon starts from a few seed words and from rated documents (at most ``rated_rows`` of them) and is re-estimated
over all sentences; a word enters it if it occurs in one of 50,000 sentences and in four, so its size is bounded by the
number of words in 50,000 sentences whatever the corpus. Addresses vote by the seed words, a source by the ratings of its
documents, so neither repeats the lexicon's votes.

Odd input: texts that are NULL, empty or without words have no row; a sentence without words is none; NULL sources do
not vote; labels of unknown subjects or documents and repeated labels change nothing; no labels at all leave the seeds;
ties go to the subject first by name; documents with the same doc_id are rated apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.lookalike import ConsistentForm, _rewriter
from evalweave.llm.shingles import code_points, few_rows, span_hashes
from evalweave.session import materialise

# A few plain words of each area in English, German and French.
SEEDS = {
    "cooking": "recipe kitchen oven soup garlic dough spicy rezept pfanne suppe kochte soße recette soupe poêle sauce",
    "everyday": "neighbour birthday weekend laundry umbrella doorbell sofa nachbarin wochenende wäsche regal fenster voisine fenêtre rue couverture",
    "finance": "bank loan invoice mortgage shareholder budget interest aktie rechnung steuer konto zinsen banque impôt emprunt facture",
    "gardening": "compost seedling hedge tulip lawn watered flowerbed gießkanne hecke unkraut rasen pflanzte pelouse haie graine arrosé",
    "law": "court lawsuit verdict judge defendant contract clause gericht klage urteil gesetz vertrag juge loi plainte contrat",
    "medicine": "patient nurse vaccine diagnosis therapy fever surgeon impfung fieber krankenhaus ärztin therapie fièvre douleur vaccin clinique",
    "music": "melody guitar violin orchestra concert rehearsal drummer geige konzert melodie orchester klavier chanson guitare mélodie partition",
    "science": "experiment molecule telescope hypothesis microscope electron laboratory labor messung hypothese molekül mikroskop planète mesure théorie molécule",
    "software": "server compiler database debugger firmware browser algorithm datenbank passwort netzwerk programm festplatte logiciel fonction requête sauvegarde",
    "sport": "goalkeeper tournament referee marathon stadium coach league turnier mannschaft training spiel tor match entraîné gardienne ligue",
    "travel": "hotel passport luggage airline itinerary hostel ferry reise gepäck fähre visum unterkunft valise plage randonnée croisière",
}
SHARE, RATED_ROWS, PASSES = 0.25, 20_000, 3
ONE_IN, LEAST = 50_000, 4
#: Ratings that a source needs to vote, and the share of them that its subject needs.
SOURCE_RATINGS, SOURCE_SHARE = 10, 0.5
#: Distinct words that a task counts before it hands its counts on.
COUNTED_WORDS = 200_000

_LETTER, _BLOCKS, _STOP, _CLOSER, _SPACE, _BREAK = 1, 2, 4, 8, 16, 32
_LINE = "\ue00a"
_ADDRESS = re.compile(r"https?://\S+|\bwww\.\S+|(?<=\w)@[\w-]+(?:\.[\w-]+)+|(?<![\w&])#[^\W\d]\w+", re.I)
_PART = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is to the splitter."""
    out = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):  # no surrogates
        chars = "".join(map(chr, range(first, last)))
        for pattern, kind in ((r"[^\W\d_]+", _LETTER), (r"[\d_@]+", _BLOCKS), (r"[.!?…]+", _STOP), ("[\"”’')»]+", _CLOSER), (r"\s+", _SPACE), (rf"[\n{_LINE}]", _BREAK)):
            for m in re.finditer(pattern, chars):
                out[first + m.start() : first + m.end()] |= kind
    return out


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words of each sentence, words of each sentence, sentences of each text).

    A word is a run of letters that no digit, underscore or @ precedes. A sentence ends at a stop, with what closes
    behind it, before white space, and at line ends.
    """
    points = code_points(texts)
    kind = _kinds()[points]
    letter = np.concatenate([[False], (kind & _LETTER) > 0, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    first, last = edges[::2], edges[1::2]
    free = np.concatenate([[True], (kind & _BLOCKS) == 0])[first]
    first, last = first[free], last[free]
    n = len(points)
    after = np.where((kind & _CLOSER) > 0, n, np.arange(n))  # the first place from each on that closes nothing
    after = np.append(np.minimum.accumulate(after[::-1])[::-1], n) if n else np.zeros(1, np.int64)
    space = np.append((kind & _SPACE) > 0, False)
    ends = ((kind & _BREAK) > 0) | (((kind & _STOP) > 0) & space[after[1:]])
    sentence = np.cumsum(ends)[first]
    words = span_hashes(points, first, last)
    doc = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]), first, "right") - 1
    order = np.lexsort((words, sentence))
    words, sentence, doc = words[order].view(np.int64), sentence[order], doc[order]
    keep = np.ones(len(words), bool)
    keep[1:] = (words[1:] != words[:-1]) | (sentence[1:] != sentence[:-1])
    words, sentence, doc = words[keep], sentence[keep], doc[keep]
    begin = np.flatnonzero(np.diff(sentence, prepend=-1))
    return words, np.diff(np.append(begin, len(words))), np.bincount(doc[begin], minlength=len(texts))


def word_keys(words: list[str]) -> np.ndarray:
    """The hashes of single words."""
    if not words:
        return np.zeros(0, np.int64)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    return span_hashes(code_points(words), end - [len(w) for w in words], end).view(np.int64)


class Lexicon:
    """word hash -> log odds of the subjects (and of none, last), in two halves by a bit of the hash."""

    def __init__(self, words: np.ndarray, probs: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.n, self.size = words[order], probs.shape[1] - 1, len(words)
        odds = np.log(np.maximum(probs[order], 1e-6) * (self.n + 1)).astype(np.float32)
        self.odds = np.vstack([odds, np.zeros((1, self.n + 1), np.float32)])  # the last row: words not in the lexicon
        self.half = np.append((self.words >> 32) & 1, 2)

    def rows(self, words: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), self.size - 1)
        return np.where(self.words[at] == words, at, self.size)

    def score(self, words: np.ndarray, sizes: np.ndarray, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, whether a word is known) of each sentence, by the words of one half or of both."""
        rows = self.rows(words)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        keep = rows < self.size if half is None else self.half[rows] == half
        rows, sentence = rows[keep], sentence[keep]
        z, known = np.zeros((len(sizes), self.n + 1), np.float32), np.zeros(len(sizes), bool)
        if len(rows):
            begin = np.flatnonzero(np.diff(sentence, prepend=-1))
            z[sentence[begin]] = np.add.reduceat(self.odds[rows], begin, axis=0)
            known[sentence[begin]] = True
        return z, known

    def choose(self, z: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subject, or n for none; its probability) of each sentence."""
        k = z.argmax(axis=1)
        p = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(known, k, self.n), np.where(known, p, 1.0)


_kept: list[tuple[object, Lexicon]] = []


def _lexicon(shared) -> Lexicon:
    """The worker's lexicon of this broadcast, built once."""
    value = shared.value
    if not _kept or _kept[0][0] is not value:
        _kept[:] = [(value, Lexicon(*value))]
    return _kept[0][1]


def _share(lexicon: tuple[np.ndarray, np.ndarray]):
    return SparkSession.getActiveSession().sparkContext.broadcast(lexicon)


def _list(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


class _Counts:
    """Class counts by word hash, merged as they come."""

    def __init__(self, width: int) -> None:
        self.width, self.words, self.counts = width, np.zeros(0, np.int64), np.zeros((0, width))

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        both, rows = np.concatenate([self.words, words]), np.concatenate([self.counts, counts])
        order = np.argsort(both, kind="stable")
        both = both[order]
        begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.words, self.counts = both[begin], np.add.reduceat(rows[order], begin, axis=0) if len(begin) else rows

    def batch(self) -> pa.RecordBatch:
        """What was counted so far; the counts start anew."""
        out = pa.RecordBatch.from_arrays([pa.array(self.words), *[pa.array(np.ascontiguousarray(self.counts[:, i])) for i in range(self.width)]], names=["word", *[f"c{i}" for i in range(self.width)]])
        self.__init__(self.width)
        return out


#: Stands for all words together, to carry the class totals.
_TOTAL = 0


def _counted(parts: DataFrame, n: int, n_sentences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, their class counts, class totals) of the words frequent enough, from the counts of all tasks."""
    summed = parts.groupBy("word").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n + 1)])
    total = sum((F.col(f"c{i}") for i in range(n + 1)), F.lit(0.0))
    rows = summed.filter((total >= max(LEAST, n_sentences / ONE_IN)) | (F.col("word") == _TOTAL)).toPandas()
    words, counts = rows["word"].to_numpy(np.int64), rows[[f"c{i}" for i in range(n + 1)]].to_numpy(float)
    return words[words != _TOTAL], counts[words != _TOTAL], counts[words == _TOTAL].sum(axis=0)


def _count_fields(n: int) -> str:
    return "word long, " + ", ".join(f"c{i} double" for i in range(n + 1))


def _seed_lexicon(rated: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon of the seed words and of the words of ``rated(words, subjects)``: a document's word counts once."""
    n = len(names)
    uniform = np.full(n + 1, 1 / (n + 1))
    seeds = [(w, k) for k, s in enumerate(names) for w in SEEDS.get(s, "").split()]
    place = {s: i for i, s in enumerate(names)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Counts(n + 1)
        for batch in batches:
            words, lengths = _list(batch.column(0))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((words, doc))
            words, doc = words[order], doc[order]
            keep = np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]) if len(words) else np.zeros(0, bool)
            classes = np.zeros((len(lengths), n + 1))
            for i, subjects in enumerate(batch.column(1).to_pylist()):
                classes[i, [place[s] for s in subjects]] = 1
            total.add(words[keep], classes[doc[keep]])
            total.add(np.array([_TOTAL]), classes.sum(axis=0, keepdims=True))
            if len(total.words) > COUNTED_WORDS:
                yield total.batch()
        yield total.batch()

    words, counts, total = _counted(rated.select("words", "subjects").mapInArrow(partial, _count_fields(n)), n, 0)
    r = counts[:, :n] / (total[:n] + 1)
    of = r.sum(axis=1)
    clear = (of > 0) & (r.max(axis=1, initial=0) > 0.5 * of)
    keys = word_keys([w for w, _ in seeds])
    clear &= ~np.isin(words, keys)
    learnt = 0.2 * uniform + np.hstack([0.8 * r[clear] / of[clear, None], np.zeros((clear.sum(), 1))])
    given = 0.1 * uniform + 0.9 * np.eye(n + 1)[[k for _, k in seeds]].reshape(len(seeds), n + 1)
    keys, at = np.unique(keys, return_index=True)
    return np.concatenate([keys, words[clear]]), np.vstack([given[at], learnt / learnt.sum(axis=1, keepdims=True)])


def _estimate(split: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], n: int, n_sentences: int) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon counted anew over all sentences whose class the present one is sure of."""
    shared = _share(lexicon)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, total = _lexicon(shared), _Counts(n + 1)
        for batch in batches:
            (words, _), (sizes, _) = _list(batch.column(0)), _list(batch.column(1))
            k, p = lex.choose(*lex.score(words, sizes))
            sure = p >= 0.8
            by_word = np.repeat(np.where(sure, k, -1), sizes)
            found, row = np.unique(words[by_word >= 0], return_inverse=True)
            total.add(found, np.bincount(row * (n + 1) + by_word[by_word >= 0], minlength=len(found) * (n + 1)).reshape(len(found), n + 1).astype(float))
            total.add(np.array([_TOTAL]), np.bincount(k[sure], minlength=n + 1).reshape(1, n + 1).astype(float))
            if len(total.words) > COUNTED_WORDS:
                yield total.batch()
        yield total.batch()

    words, counts, total = _counted(split.select("words", "sizes").mapInArrow(partial, _count_fields(n)), n, n_sentences)
    r = (counts + 0.3) / (total + 50)
    r /= r.sum(axis=1, keepdims=True)
    keep = (r[:, :n].max(axis=1, initial=0) > 0.3) | (r[:, n] > 0.6)
    return words[keep], r[keep]


def sentence_votes(words: np.ndarray, sizes: np.ndarray, per: np.ndarray, lex: Lexicon) -> np.ndarray:
    """(sentences, 3): the votes of both halves and of the section; ``per`` has the sentences of each document.

    The section votes with the sure votes of the two sentences before and the two behind.
    """
    scores = [lex.score(words, sizes, h) for h in (0, 1)]
    halves = [np.where(p >= 0.5, k, lex.n) for k, p in (lex.choose(*s) for s in scores)]
    k, p = lex.choose(scores[0][0] + scores[1][0], scores[0][1] | scores[1][1])
    sure = np.where((k < lex.n) & (p >= 0.8), k, -1)
    doc = np.repeat(np.arange(len(per)), per)
    near = np.zeros((len(k), lex.n), np.int8)
    for step in (1, 2):
        for a, b in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
            # sentence b sees sentence a where both are of one document
            ok = np.flatnonzero((doc[a] == doc[b]) & (sure[a] >= 0))
            near[np.arange(len(k))[b][ok], sure[a][ok]] += 1
    section = np.where(near.max(axis=1, initial=0) > 0, near.argmax(axis=1), lex.n) if lex.n and len(k) else np.full(len(k), lex.n)
    return np.stack([*halves, section], axis=1)


def address_vote(text: str, seeds: dict[str, int], n: int) -> int:
    """The subject that most seed words in links, mail hosts and hashtags of ``text`` speak for; n for none or a tie."""
    if "#" not in text and "://" not in text and "@" not in text and "www." not in text.lower():
        return n
    found = np.zeros(n + 1, np.int64)
    for a in _ADDRESS.findall(text):
        for w in _PART.findall(a.lower()):
            found[seeds.get(w, n)] += 1
    best = found[:n].max(initial=0)
    return int(found[:n].argmax()) if best and (found[:n] == best).sum() == 1 else n


def latent_accuracies(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit, miss, none) of each labelling function, by expectation-maximisation over the vote patterns.

    A function votes for the true subject with probability hit, abstains with miss and errs evenly otherwise; on a
    sentence of no subject it abstains with probability none. ``n`` as a vote is an abstention.
    """
    j = patterns.shape[1]
    hit, miss, none = np.full(j, 0.7), np.full(j, 0.2), np.full(j, 0.7)
    prior = np.full(n + 1, 1 / (n + 1))
    for _ in range(rounds):
        post = posterior(patterns, hit, miss, none, prior, n)
        w = post * counts[:, None]
        prior = (w.sum(axis=0) + 1) / (w.sum() + n + 1)
        subject = w[:, :n].sum()
        for f in range(j):
            v = patterns[:, f]
            right = w[np.arange(len(v)), np.minimum(v, n - 1)][v < n].sum()
            away = w[v == n, :n].sum()
            hit[f], miss[f] = (right + 1) / (subject + 3), (away + 1) / (subject + 3)
            none[f] = (w[v == n, n].sum() + 1) / (w[:, n].sum() + 2)
    return hit, miss, none, prior


def posterior(patterns: np.ndarray, hit: np.ndarray, miss: np.ndarray, none: np.ndarray, prior: np.ndarray, n: int) -> np.ndarray:
    """(patterns, n + 1) probabilities of each subject and of none."""
    log = np.tile(np.log(prior), (len(patterns), 1))
    for f in range(patterns.shape[1]):
        v = patterns[:, f]
        err = np.maximum((1 - hit[f] - miss[f]) / max(n - 1, 1), 1e-9)
        like = np.full((len(v), n + 1), err)
        like[v == n, :n] = miss[f]
        voted = v < n
        like[np.flatnonzero(voted), v[voted]] = hit[f]
        like[:, n] = np.where(voted, (1 - none[f]) / n, none[f])
        log += np.log(np.maximum(like, 1e-12))
    e = np.exp(log - log.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: list[str], rated_rows: int = RATED_ROWS, passes: int = PASSES) -> DataFrame:
    """(doc_id, subject, sentences, share): the share of the document's sentences expected of each subject, where not zero.

    ``docs`` has doc_id, text and source; ``labels`` doc_id and subject; ``subjects`` their names.
    """
    names = sorted({s for s in subjects if s})
    n = len(names)
    spark = docs.sparkSession
    pairs = spark.sparkContext.broadcast(ConsistentForm.default().pairs)
    seeds = {w: k for k, s in enumerate(names) for w in (s.lower(), *SEEDS.get(s, "").split())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _rewriter(pairs.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                raw = part.column(1).to_pylist()
                # one rewriting of the whole text; line ends are kept as ends of sentences
                words, sizes, per = split_words([(form(t.replace("\n", f" {_LINE} ")) or "").lower() for t in raw])
                some = pa.array(np.flatnonzero(per))
                address = np.array([address_vote(t, seeds, n) for t in raw], np.int32)
                per_words = np.bincount(np.repeat(np.arange(len(per)), per), weights=sizes, minlength=len(per)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(address), _lists(words, per_words, pa.int64()), _lists(sizes, per, pa.int32())], names=["doc_id", "source", "address", "words", "sizes"]).take(some)

    raw = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.lower(F.trim("source")).alias("source"))
    split = materialise(raw.mapInArrow(cut, "doc_id long, source string, address int, words array<long>, sizes array<int>"), "p8-split")
    n_sentences = split.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    if not n or not n_sentences:
        return spark.createDataFrame([], "doc_id long, subject string, sentences int, share double")
    rated = labels.filter(F.col("subject").isin(names)).select("doc_id", "subject").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(rated_rows)
    rated = rated.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    rated = materialise(split.select("doc_id", "source", "words").join(F.broadcast(rated), "doc_id"), "p8-rated")  # rated_rows at most
    lexicon = _seed_lexicon(rated, names)
    for _ in range(passes):
        lexicon = _estimate(split, lexicon, n, n_sentences)

    by_source = rated.filter("source is not null").select("source", F.explode("subjects").alias("subject")).groupBy("source", "subject").agg(F.count("*").alias("k"))
    best = by_source.groupBy("source").agg(F.max(F.struct(F.col("k"), F.col("subject"))).alias("top"), F.sum("k").alias("all")).filter((F.col("all") >= SOURCE_RATINGS) & (F.col("top.k") > SOURCE_SHARE * F.col("all")))
    source_votes = best.select("source", (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("top.subject")) - 1).cast("int").alias("source_vote"))
    voters = split.join(few_rows(source_votes), "source", "left").select("doc_id", F.col("address"), F.coalesce("source_vote", F.lit(n)).alias("source_vote"), "words", "sizes")
    shared, base = _share(lexicon), n + 1

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(shared)
        for batch in batches:
            (words, _), (sizes, per) = _list(batch.column(3)), _list(batch.column(4))
            v = sentence_votes(words, sizes, per, lex)
            code = (v[:, 0] * base + v[:, 1]) * base + v[:, 2]
            whole = batch.column(1).to_numpy().astype(np.int64) * base + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(code * base * base + np.repeat(whole, per), per, pa.int32())], names=["doc_id", "codes"])

    voted = materialise(voters.mapInArrow(vote, "doc_id long, codes array<int>"), "p8-votes")
    counted = voted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("k")).toPandas()  # at most (subjects + 1) ** 5 rows
    codes = np.sort(counted["code"].to_numpy(np.int64))
    counts = counted.set_index("code")["k"].reindex(codes).to_numpy(float)
    patterns = np.stack([codes // base**i % base for i in range(4, -1, -1)], axis=1)
    model = latent_accuracies(patterns, counts, n)
    table = spark.sparkContext.broadcast((codes, posterior(patterns, *model, n)[:, :n].astype(np.float32)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, post = table.value
        for batch in batches:
            code, per = _list(batch.column(1))
            if not len(code):
                continue
            mass = np.add.reduceat(post[np.searchsorted(known, code)], np.cumsum(per) - per, axis=0)
            # expected sentences in whole sentences: a single one of 0.97 still is a sentence
            whole = np.floor(mass + 0.5)
            d, k = np.nonzero(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([names[i] for i in k], pa.string()), pa.array(per[d].astype(np.int32)), pa.array((whole[d, k] / per[d]).astype(float))], names=["doc_id", "subject", "sentences", "share"])

    return voted.mapInArrow(assign, "doc_id long, subject string, sentences int, share double")


def subject_mix(areas: DataFrame, n_docs: int) -> DataFrame:
    """(subject, n_docs, share_of_docs) of the corpus."""
    return areas.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs")).withColumn("share_of_docs", F.col("n_docs") / F.lit(n_docs))
