"""Problem 3: one consistent form for text that looks the same.

Look-alike relations hold between strings: a code point and the string it stands for (full width, mathematical
letters, ligatures), a letter and one of another script, a letter and its base plus combining mark, an invisible code
point and the empty string. Union-find closes the relations into classes; of each class the member seen most often in
the corpus represents it; an Aho-Corasick automaton of all other members rewrites text from the left, longest first.

The relations are fixed by Unicode and the table below, never by the data, so what the driver collects (counts of the
strings in the relations) has a bound independent of the corpus.

Results for odd input: NULL text gives a NULL form; empty, blank or wholly invisible text gives the empty form; texts of
any length are rewritten whole; ties between representatives go to the shorter, then the smaller string, plain ASCII first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.session import materialise

# Letters of other scripts that are drawn like a Latin letter.
LETTERS = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уүγ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅᏚꓢ", "T": "ТΤᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "УΥҮꓬ", "Z": "ΖᏃꓜ", "-": "‐‑",
}
# Code points without a visible mark. Joiners are handled apart where they change what is seen.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe01\ufe0e\ufe0f\ufeff"
SELECTORS = "".join(map(chr, (*range(0xFE02, 0xFE0E), *range(0xE0100, 0xE01F0))))
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Compatibility mappings that keep the look; superscripts, fractions, circled and squared signs are seen as different.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"}

_EMOJI = "\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
_JOINED = re.compile(f"(?<=[{_EMOJI}\ufe0f])\u200d(?=[{_EMOJI}])|(?<=[\u0600-\u0dff])[\u200c\u200d]|[\u200c\u200d](?=[\u0600-\u0dff])")
_KEPT = {"\u200c": "\ue00c", "\u200d": "\ue00d"}
_RESTORE = str.maketrans({v: k for k, v in _KEPT.items()})
_CLUSTER = re.compile("[^\u0300-\u036f][\u0300-\u036f]+")


class UnionFind:
    """Classes of strings under a relation, closed transitively."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return {r: m for r, m in out.items() if len(m) > 1}


@lru_cache(maxsize=1)
def relation() -> tuple[tuple[str, ...], ...]:
    """The look-alike classes, each a sorted tuple of strings. Depends on Unicode and the tables above only."""
    uf = UnionFind()
    for c in INVISIBLE + SELECTORS:
        uf.union("", c)
    for c in SPACES:
        uf.union(" ", c)
    for latin, others in LETTERS.items():
        for c in others:
            uf.union(latin, c)
    composed: list[tuple[str, str, str]] = []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if not d or 0xAC00 <= cp <= 0xD7A3:
            continue
        tag, *parts = d.split() if d[0] == "<" else ("", *d.split())
        text = "".join(chr(int(x, 16)) for x in parts)
        if tag in SAME_LOOK:
            blocked = 0x2474 <= cp <= 0x24FF or 0xF900 <= cp <= 0xFAFF or (tag == "<compat>" and 0x2100 <= cp <= 0x214F)
            full = unicodedata.normalize("NFKC", c)
            if not blocked and full.strip() and not full[0].isspace() and not full.startswith(" "):
                uf.union(c, full)
        elif not tag and len(text) == 1:
            uf.union(c, text)
        elif not tag and len(text) == 2 and "\u0300" <= text[1] <= "\u036f":
            composed.append((c, text[0], text[1]))
    # A letter with a mark equals every look-alike of its base with that mark; bases may themselves carry marks.
    for _ in range(2):
        members: dict[str, list[str]] = {}
        for x in list(uf.parent):
            members.setdefault(uf.find(x), []).append(x)
        for c, base, mark in composed:
            uf.union(c, base + mark)
            for other in members.get(uf.find(base), ()) if base in uf.parent else ():
                if len(other) <= 2:
                    uf.union(c, other + mark)
    return tuple(sorted(tuple(sorted(m)) for m in uf.classes().values()))


# What the Latin ligatures of the Unicode standard and the ellipsis stand for.
_USUAL = ("ff", "fi", "fl", "ffi", "ffl", "st", "...")


def count_strings(texts: pd.Series, plain: tuple[str, ...] = _USUAL) -> Counter:
    """Occurrences of single code points, of bases with marks and of the given plain strings."""
    joined = "\n".join(t for t in texts if t)
    points = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    n: Counter = Counter({chr(c): int(points[c]) for c in np.flatnonzero(points)})
    if points[0x300:0x370].any():
        n.update(_CLUSTER.findall(joined))
    for s in plain:
        if k := joined.count(s):
            n[s] += k
    return n


def uncounted(counts: dict[str, int]) -> tuple[str, ...]:
    """Plain strings not counted yet that stand against a sign seen in the corpus."""
    return tuple(sorted(s for c in relation() if any(counts.get(m) for m in c if not m.isascii()) for s in c if len(s) > 1 and s.isascii() and s not in _USUAL))


@lru_cache(maxsize=1)
def _nodes() -> frozenset[str]:
    return frozenset(s for c in relation() for s in c)


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative, for every member that must be rewritten."""
    out: dict[str, str] = {}
    for members in relation():
        if "" in members:
            best = ""  # nothing is between any two letters, so the empty string is always the most frequent
        else:
            best = min(members, key=lambda s: (-counts.get(s, 0), not s.isascii(), len(s), s))
        out.update({m: best for m in members if m != best and m})
    return out


class Rewriter:
    """Rewrites text to its form. Built once per Python worker from the pairs that differ."""

    def __init__(self, pairs: dict[str, str], final: dict[str, str] | None = None) -> None:
        self.pairs, self.final = pairs, final or {}
        self.last = ahocorasick.Automaton()
        for k, v in self.final.items():
            self.last.add_word(k, (len(k), v))
        if self.final:
            self.last.make_automaton()
        plain = sorted((k for k in pairs if k.isascii()), key=len, reverse=True)
        self.plain = re.compile("|".join(map(re.escape, plain))).search if plain else lambda _: None
        # every pattern holds one of these: a text without any of them is its own form
        self.marks = frozenset(next((c for c in reversed(k) if not c.isascii()), "") for k in pairs) - {""}
        self.auto = ahocorasick.Automaton()
        for k, v in pairs.items():
            self.auto.add_word(k, (len(k), v))
        if pairs:
            self.auto.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        plain = text.isascii()
        if self.pairs and (not plain and (not self.marks.isdisjoint(text) or not unicodedata.is_normalized("NFC", text)) or self.plain(text)):
            held = "\u200c" in text or "\u200d" in text
            if held:
                text = _JOINED.sub(lambda m: _KEPT[m.group()], text)
            for _ in range(4):  # a rewritten base may complete a pattern with the mark behind it
                # canonical composition puts marks in order and joins what the relation, which knows Latin marks only, leaves apart
                new_text = _rewrite(self.auto, unicodedata.normalize("NFC", text))
                if new_text == text:
                    break
                text = new_text
            if held:
                text = text.translate(_RESTORE)
        text = " ".join(text.split())
        return _rewrite(self.last, text) if self.final else text


def _rewrite(auto: ahocorasick.Automaton, text: str) -> str:
    """Every longest pattern of ``auto``, from the left, by what it stands for."""
    out, at = [], 0
    for end, (size, new) in auto.iter_long(text):
        out += text[at : end + 1 - size], new
        at = end + 1
    return "".join(out) + text[at:] if at else text


@lru_cache(maxsize=4)
def _rewriter(pairs: tuple[tuple[str, str], ...], final: tuple[tuple[str, str], ...] = ()) -> Rewriter:
    return Rewriter(dict(pairs), dict(final))


class ConsistentForm:
    """The fitted form. ``fit`` counts over all rows; ``column`` applies it.

    Text is first rewritten to the members that represent their classes without counts, and only then to the fitted
    ``representatives``: which texts are equal does not depend on the counts.
    """

    def __init__(self, representatives_: dict[str, str]) -> None:
        usual = representatives({})
        self.pairs = tuple(sorted(usual.items()))
        # spaces are joined to single ones in any case
        kept = [next(x for x in c if x not in usual) for c in relation() if not {"", " "} & set(c)]
        self.final = tuple(sorted((rep, new) for rep in kept if (new := representatives_.get(rep, rep)) != rep))

    @classmethod
    def fit(cls, texts: DataFrame, column: str = "text") -> ConsistentForm:
        counts = cls._count(texts, column, _USUAL)
        if rest := uncounted(counts):
            seen = cls._count(texts, column, rest)
            counts |= {s: seen.get(s, 0) for s in rest}
        return cls(representatives(counts))

    @staticmethod
    def _count(texts: DataFrame, column: str, plain: tuple[str, ...]) -> dict[str, int]:
        nodes = _nodes()

        def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for pdf in it:
                total.update({k: v for k, v in count_strings(pdf.iloc[:, 0], plain).items() if k in nodes})
            yield pd.DataFrame({"s": list(total.keys()), "n": list(total.values())}).astype({"s": "object", "n": "int64"})

        rows = texts.select(F.col(column)).mapInPandas(partial, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
        return {r["s"]: r["n"] for r in rows}

    @classmethod
    def default(cls) -> ConsistentForm:
        """Without counts: the shortest, then smallest member represents its class."""
        return cls(representatives({}))

    def column(self, text: Column | str) -> Column:
        shared = _broadcast((self.pairs, self.final))

        @F.pandas_udf(T.StringType())
        def form(s: pd.Series) -> pd.Series:
            return s.map(_rewriter(*shared.value), na_action="ignore")

        return form(text)

    def apply(self, text: str | None) -> str | None:
        return _rewriter(self.pairs, self.final)(text)


def _broadcast(value):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(value)


def lookalike_variants(texts: DataFrame, form: ConsistentForm, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(form_key, text_key, id): every id whose text has a look-alike twin spelled otherwise.

    ``texts`` has one row per id. Forms and texts are compared by 128-bit digests. Copies of one text share a text_key
    and make no pair among themselves.
    """
    t = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("text_key"), form.column(F.col(text_col)).alias("form"))
    t = materialise(t.filter(F.col("form") != "").select("id", "text_key", F.md5(F.col("form").cast("binary")).alias("form_key")), "p3-keys")
    many = t.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo <> hi").select("form_key")
    return t.join(many, "form_key")


def lookalike_pairs(variants: DataFrame, salt_rows: int = 512) -> DataFrame:
    """(id_a, id_b): pairs of ids with equal form and different text, the smaller id first.

    Different spellings are paired first and their ids joined to the pairs, so a group of exact copies costs no work
    beyond the rows it contributes. Forms with many spellings are salted over many tasks.
    """
    spelt = materialise(variants.select("form_key", "text_key").distinct(), "p3-spelt")
    salts = spelt.groupBy("form_key").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    spelt = spelt.join(salts, "form_key")
    x = spelt.select("form_key", F.col("text_key").alias("ka"), F.pmod(F.xxhash64("text_key"), "salts").cast("int").alias("salt"))
    y = spelt.select("form_key", F.col("text_key").alias("kb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    twins = x.join(y, ["form_key", "salt"]).filter("ka < kb").select("form_key", "ka", "kb")
    a = variants.select("form_key", F.col("text_key").alias("ka"), F.col("id").alias("ia"))
    b = variants.select("form_key", F.col("text_key").alias("kb"), F.col("id").alias("ib"))
    both = twins.join(a, ["form_key", "ka"]).join(b, ["form_key", "kb"]).filter("ia <> ib")
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
