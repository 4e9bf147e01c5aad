"""Problem 5: question and answer pairs whose answer is defective.

Method: ordered rules on the final answer: emptiness, unclosed delimiters, abrupt endings, refusal phrases in the
languages that the language rule knows, copied text, and mismatch of script or, within a script, of language. Every rule
that fires is reported in ``defects`` (an answer that says nothing has nothing the other rules could judge); the first in
ORDER is ``defect``.

Whether a reasoning without a final full stop stops early is decided by the corpus: it is complete if its last two words
(where they are rare, its last word) end a sentence at a fair share of the places where they occur. Shares, unlike counts,
do not grow with the table. These statistics cover all answers.

Odd input: no answers, a NULL last answer, blank or invisible text and empty objects are ``empty``; an item without text
can show neither copying nor another language; runs with the same id count once (the first logged); an empty table gives
no rows. Texts are read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.lookalike import ConsistentForm, _rewriter
from evalweave.session import materialise
from evalweave.sources.tables import first_per_key

#: Share of the answer's words that must come from the item for a copy, and the least number of words.
COPIED, COPIED_WORDS = 0.8, 5
#: A sentence may end in words that do so at this share of their occurrences. A word's share counts as if it had been seen
#: WORD_SEEN times more at share WORD_SHARE, a pair's as if PAIR_SEEN times more at the share of its last word.
END_SHARE, WORD_SEEN, WORD_SHARE, PAIR_SEEN = 0.2, 10, 0.05, 5
#: Letters that a text needs to show its script, fewer in scripts whose signs are words, and their share of all letters.
SCRIPT_LETTERS, SCRIPT_SIGNS, SCRIPT_SHARE = 12, 4, 0.6
#: Share of ASCII characters from which letters are not counted.
PLAIN_SHARE = 0.85
#: Keys that a task counts before it hands its counts on.
COUNTED_KEYS = 200_000

# Answers that say nothing.
VACUOUS = {"", "n a", "na", "none", "null", "nil", "nothing", "keine", "keiner", "keines", "nichts", "k a", "leer", "aucun", "aucune", "rien", "ninguno", "ninguna", "nada", "unknown", "tbd", "empty", "undefined", "no reasoning", "no reason", "keine angabe", "keine begründung", "sans objet", "sin motivo"}
# First-person refusals, by language. A third person who refuses or apologises in the text is none.
REFUSALS = [
    r"^i(?: am|'m)? (?:must |have to |will |would |need to )?(?:respectfully |politely )?(?:decline|refuse|abstain)\b",
    r"^(?:unfortunately,? |regrettably,? |sorry,? |but )*i(?: really| simply)? ?(?:cannot|can't|can not|could not|won't|will not|am unable|'m unable|am not able|'m not able|am not allowed|'m not allowed|am not permitted|may not|do not wish|don't wish|'d rather not|would rather not|prefer not|do not comment|don't comment|do not judge|don't judge|do not rate|don't rate|do not give|don't give)\b",
    r"^(?:i'm |i am )?(?:very |truly |so )?sorry,? (?:but|that is|that's|i |this)",
    r"^(?:my apologies|i apologi[sz]e|apologies)\b",
    r"^as an? (?:ai|artificial|automated|language|large|virtual|digital|neutral)?[ -]?(?:intelligence|system|model|language|assistant|chatbot|machine|moderation|program|tool|ai)\b.{0,40}\bi\b",
    r"^my (?:guidelines|policies|policy|settings|instructions|rules|programming|configuration|training|safety)\b.{0,40}\b(?:prevent|keep|forbid|prohibit|stop|bar|do not|don't|does not|doesn't)",
    r"^it (?:would be|is|wouldn't be|would not be|isn't) (?:in)?appropriate for me\b",
    r"^no (?:answer|assessment|judg(?:e)?ment|rating|label|verdict) (?:can|will|may) be given\b",
    r"^let(?:'s| us) (?:talk|speak|discuss|chat|turn)\b.{0,30}\b(?:different|else|other)",
    r"\bfalls outside (?:of )?what i\b|\bi(?:'m| am) not comfortable\b|\bnot something i(?:'m| am| can| will)\b",
    r"^(?:entschuldigung|entschuldige|verzeihung|tut mir leid|es tut mir leid|bedaure|sorry)\b.{0,60}\b(?:nicht|kein|keine)\b",
    r"^(?:leider |hier |dazu |darüber |dabei |hierzu |so etwas |das |dies )*(?:kann|darf|werde|möchte|will|mag) ich\b.{0,60}\b(?:nicht|kein|keine|keinen|nichts)\b",
    r"^ich (?:kann|darf|werde|möchte|will|mag|muss)\b.{0,80}\b(?:nicht|kein|keine|keinen|nichts|ablehnen|zurückweisen|verweigern)\b",
    r"^ich (?:lehne|weigere|verweigere|bin nicht in der lage|bin nicht befugt|bewerte keine|beurteile keine)\b",
    r"^(?:diese|diesen|dieses|die|den|das|eine solche)\b.{0,40}\bmuss ich (?:leider )?(?:ablehnen|zurückweisen|verweigern)\b",
    r"^als (?:ki|assistent|assistentin|sprachmodell|sprachassistent|automatisches|automatisiertes|künstliche|maschine|system)\b.{0,60}\bich\b.{0,60}\b(?:nicht|kein|keine|keinen)\b",
    r"^über\b.{0,60}\b(?:kann|darf|möchte|will|werde|rede|spreche|urteile|mag) ich\b.{0,40}\b(?:nicht|kein|keine)\b",
    r"^lieber nicht\b|^dafür stehe ich\b.{0,20}\bnicht\b|^dazu (?:äußere|sage) ich\b",
    r"^meine (?:vorgaben|richtlinien|regeln|einstellungen|anweisungen|vorschriften|grundsätze|programmierung)\b.{0,40}\b(?:erlauben|verbieten|untersagen|verhindern|lassen|gestatten)\b",
    r"^(?:hier|dazu) (?:kann|darf|gibt)\b.{0,40}\bkeine (?:antwort|bewertung|auskunft)\b|^keine (?:antwort|bewertung) (?:möglich|kann)",
    r"^(?:désolée?|je suis désolée?|je regrette|excusez-moi|mes excuses)\b",
    r"^(?:malheureusement,? )?je ne (?:peux|puis|suis|veux|souhaite|saurais|commente|juge)\b.{0,60}\b(?:pas|aucune?)\b|^je (?:refuse|dois refuser|décline|préfère ne pas)\b",
    r"^en tant qu(?:e|')\b.{0,60}\bje ne\b|^mes (?:consignes|règles|directives|instructions)\b.{0,60}\b(?:interdisent|empêchent|permettent pas|autorisent pas)\b",
    r"^(?:lo siento|lo lamento|perdón|disculpa|disculpe|mis disculpas)\b",
    r"^(?:lamentablemente,? |por desgracia,? )?no (?:puedo|podré|quiero|deseo|me es posible|estoy autorizad[oa])\b|^(?:debo|tengo que) (?:rechazar|negarme|declinar)\b|^prefiero no\b",
    r"^(?:mi dispiace|sono spiacente|mi scuso|purtroppo non (?:posso|sono|mi è))\b|^non (?:posso|voglio|sono in grado|mi è possibile|intendo|desidero)\b.{0,60}|^(?:devo|preferisco) (?:rifiutare|declinare|non)\b|^mi rifiuto\b|^rifiuto di\b",
    r"^come (?:modello|assistente|ia|sistema)\b.{0,60}\bnon\b|^le mie (?:linee guida|regole|istruzioni)\b.{0,60}\b(?:impediscono|vietano|non)\b",
    r"^(?:sorry|het spijt me|helaas|excuses)\b.{0,60}\b(?:niet|geen)\b|^(?:ik (?:kan|mag|wil|zal|moet|weiger)|hier kan ik|dat kan ik|daar kan ik)\b.{0,80}\b(?:niet|geen|weigeren|afwijzen)\b|^ik (?:weiger|wijs dit|onthoud me)\b",
    r"^als (?:taalmodel|assistent|ai|ki-model|systeem)\b.{0,60}\bik\b.{0,60}\b(?:niet|geen)\b|^mijn (?:richtlijnen|regels|instructies)\b.{0,60}\b(?:verbieden|niet|geen|verhinderen)\b",
    r"^(?:desculpe|desculpa|lamento|sinto muito|infelizmente,? não)\b|^(?:eu )?não (?:posso|quero|consigo|estou autorizad[oa]|me é possível|vou|desejo)\b|^(?:devo|tenho de|tenho que|prefiro) (?:recusar|declinar|não)\b|^recuso\b|^recuso-me\b",
    r"^como (?:um )?(?:modelo|assistente|ia|sistema)\b.{0,60}\bnão\b|^(?:as )?minhas (?:regras|diretrizes|instruções)\b.{0,60}\b(?:impedem|proíbem|não)\b",
    r"^(?:przykro mi|przepraszam|niestety)\b.{0,60}\bnie\b|^nie (?:mogę|chcę|jestem w stanie|będę|wolno mi|zamierzam)\b|^(?:muszę|wolę) (?:odmówić|nie)\b|^odmawiam\b|^jako (?:model|asystent|sztuczna|system)\b.{0,60}\bnie\b|^moje (?:zasady|wytyczne|instrukcje)\b.{0,60}\b(?:nie|zabraniają|zakazują)\b",
    r"^(?:üzgünüm|özür dilerim|maalesef)\b|\b(?:yardımcı olamam|yanıt veremem|cevap veremem|değerlendiremem|yapamam|reddediyorum|reddetmek zorundayım|yorum yapamam)\b",
    r"^(?:извините|простите|мне жаль|к сожалению)\b|^я (?:не могу|не буду|не хочу|отказываюсь|вынужден[а]? отказать|не вправе|не имею права)\b|^как (?:модель|ассистент|ии|языковая модель)\b.{0,60}\bне\b",
    r"^(?:对不起|抱歉|很抱歉|對不起|我无法|我無法|我不能|我拒绝|我拒絕|恕我|作为.{0,12}我不|作為.{0,12}我不)",
    r"^(?:عذرا|عذراً|آسف|أعتذر|للأسف)|^(?:لا أستطيع|لا يمكنني|لن أقوم|أرفض|لا أريد|لست قادرا)",
    r"^como (?:modelo|asistente|ia|sistema)\b.{0,60}\bno\b|^mis (?:normas|directrices|reglas|instrucciones)\b.{0,60}\b(?:impiden|prohíben|no)\b",
]
# Function words that are frequent in one of the languages.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for on with as by at this from or be are which not an they their has have its about does than how would could should them who because although yet so what when there".split(),
    "de": "der die das und ist nicht ein eine zu den mit von im auf für dem des sich als auch es an wird aus wie oder nur wenn aber noch nach über eher dass bei war einer eines einem einen doch sie wer was hier ohne kaum".split(),
    "fr": "le la les des et est un une du que qui dans pour pas ne sur au avec ce cette il elle sont par plus mais ou de en se son sa ses leur comme aux cela être".split(),
    "es": "el los las y es un una del que en para no con por su al lo como más pero o se esta este son sobre una unos ha fue entre también sin le ni sus muy".split(),
    "it": "il lo gli e è un una che di per non con su del della dei nel sono come più ma o si questa questo anche le al dal".split(),
    "nl": "de het een en van is dat op te met voor niet zijn aan er om ook als maar bij naar uit wordt deze die of".split(),
    "pl": "się jest że nie jak ale przez dla był była są ten tego który która które może oraz jego jej ich tym tej lub gdy czy już tylko bardzo przy bez także jako".split(),
    "tr": "ve bir bu için ile çok daha gibi olarak değil ama olan ancak veya kadar sonra hem her şey var yok onun bunu şu sadece bile hiçbir".split(),
    "pt": "o os as e é um uma que de para não com por do da em no na mas ou se são mais como ao dos das sua".split(),
}
_WORD = re.compile(r"[^\W_]+")
_ASCII_LETTERS = re.compile(r"[a-zA-Z]+")
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_FENCES = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_KEY = re.compile(r"""["']?\s*reasoning\s*["']?\s*:\s*(["'])""", re.I)
_END = re.compile(r"[.!?…](?=\s|$|[\"'”»)])")
_QUOTED = re.compile(r"(?:(?<=\s)|^)'[^']{3,400}'(?=\W|$)|\"[^\"]{3,400}\"|“[^”]{3,400}”|«[^»]{3,400}»")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@lru_cache(maxsize=1)
def _refusal():
    """One pattern for refusals that open a sentence, one for those anywhere in it."""
    opening = [x for p in REFUSALS for x in p.split("|^") if p.startswith("^")]
    inside = [p for p in REFUSALS if not p.startswith("^")]
    return re.compile("|".join(f"(?:{x.removeprefix('^')})" for x in opening), re.I | re.S).match, re.compile("|".join(inside), re.I | re.S).search


@lru_cache(maxsize=1)
def _speaks_for() -> tuple[list[str], dict[str, list[int]]]:
    """The languages and, for each function word, the places of those it speaks for."""
    names, out = list(FUNCTION_WORDS), {}
    for i, k in enumerate(names):
        for w in set(FUNCTION_WORDS[k]):
            out.setdefault(w, []).append(i)
    return names, out


def language(text: str) -> tuple[str | None, int, int]:
    """(language, its function words, those of the runner-up); None where nothing speaks for one."""
    names, speaks = _speaks_for()
    n = [0] * len(names)
    for w in _WORD.findall(text.lower()):
        for i in speaks.get(w, ()):
            n[i] += 1
    first, second = sorted(n, reverse=True)[:2]
    return (names[n.index(first)] if first > second else None, first, second)


@lru_cache(maxsize=1 << 14)
def _script_of(ch: str) -> str | None:
    """The script of a letter by its Unicode name; the scripts that Chinese, Japanese and Korean texts mix are one."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "?").split()
    first = name[1] if name[0] in ("FULLWIDTH", "HALFWIDTH", "MODIFIER") and len(name) > 1 else name[0].partition("-")[0]
    return "EAST-ASIAN" if first in {"CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO"} else first


def script(text: str) -> tuple[str | None, int]:
    """(script of most letters, its letters); None where it has not SCRIPT_SHARE of the letters."""
    n: Counter = Counter()
    if not text.isascii():
        for ch, k in Counter(text).items():
            if ch > "\x7f" and (s := _script_of(ch)):
                n[s] += k
        text = "".join(_ASCII_LETTERS.findall(text))
    n["LATIN"] += len(text) if text.isalpha() else sum(map(str.isalpha, text))
    best, k = n.most_common(1)[0]
    return (best, k) if k and k >= SCRIPT_SHARE * n.total() else (None, k)


def refuses(text: str) -> bool:
    opens, holds = _refusal()
    text = text.replace("\u2019", "'").strip()
    return bool(holds(text)) or any(opens(s.strip()) for s in _SENTENCE.split(text))


def closes(text: str, start: int) -> bool:
    """Whether the object that opens at ``start`` is closed, with strings in either quote and escapes honoured.

    An apostrophe opens a string only where a value or a key may begin.
    """
    depth, quote, escaped, before = 0, "", False, ""
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == quote and (quote == '"' or text[i + 1 : i + 2] in ",:}] \n" or i + 1 == len(text)):
                quote = ""
                before = ch
            continue
        if ch == '"' and before in "{[,:" or ch == "'" and before in "{[,:":
            quote = ch
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return True
        if not ch.isspace():
            before = ch
    return False


def read_answer(final: str | None) -> tuple[str, str | None]:
    """(state, what it says): state is empty, cut, object (parsed), loose (complete, not parsed) or prose."""
    if final is None or not _WORD.search(final):
        return "empty", None
    text = _THINK.sub("", final)
    if "<think>" in text.lower():
        return "cut", text.lower().partition("<think>")[2]
    text = text.strip()
    text = _FENCES.sub("", _FENCES.sub("", text)).strip()
    if not _WORD.search(text) or text.lower() in {"null", "none", '"null"', '"none"'}:
        return "empty", None
    at = text.find("{")
    if at < 0:
        if text[0] == '"':
            try:
                text = json.loads(text)
            except ValueError:
                pass
        return "prose", str(text)
    try:
        obj, _ = json.JSONDecoder().raw_decode(text[at:])
        said = next((v for k, v in obj.items() if str(k).strip().lower() == "reasoning"), None)
        return "object", said if isinstance(said, str) else "" if said is None else json.dumps(said)
    except ValueError:
        pass
    m, whole = _KEY.search(text, at), closes(text, at)
    said = None
    if m:
        q = m.group(1)
        end = re.compile(rf"(?<!\\){q}\s*[,}}]\s*(?:{q}|$)").search(text, m.end())
        said = text[m.end() : end.start()] if end else text[m.end() :].rstrip("}\n `")
    elif whole:
        said = text[at:].strip("{}[] \n")
    return ("loose" if whole else "cut"), said


def other_script(said: str, item: str) -> bool:
    """Whether both texts show their script and it is not the same. Stored texts are compared: the consistent form may
    replace a letter by its twin in another script. Texts of nearly ASCII characters only are taken for Latin at once."""
    if all(len(t.encode("ascii", "ignore")) >= PLAIN_SHARE * len(t) for t in (said, item)):
        return False
    (a, na), (b, nb) = script(said), script(item)
    enough = lambda s, n: n >= (SCRIPT_SIGNS if s == "EAST-ASIAN" else SCRIPT_LETTERS)
    return bool(a and b and a != b and enough(a, na) and enough(b, nb))


def copies(said: str, item: str) -> bool:
    words, given = _WORD.findall(said), Counter(_WORD.findall(item))
    if len(words) < COPIED_WORDS:
        return False
    shared = sum(min(n, given[w]) for w, n in Counter(words).items())
    return shared >= COPIED * len(words)


def judge(final: str | None, item: str | None, form) -> tuple[list[str], str | None, str | None, list[tuple[list[str], bool]]]:
    """(defects in rule order, last word pair and last word if the end is open, sentences as words and whether they end).

    The last word of an open end is in no sentence: what would follow it is not known.
    """
    state, said = read_answer(final)
    if state == "empty":
        return ["empty"], None, None, []
    found: list[str] = []
    plain = form(said or "") or ""
    key = " ".join(w.lower() for w in _WORD.findall(plain))
    if state in ("object", "loose") and (key in VACUOUS):
        return ["empty"], None, None, []
    if state == "cut":
        found.append("truncated")
    # the consistent form may hold letters of another script, so phrases are looked for in the stored text too
    if refuses(plain) or said and said != plain and refuses(said):
        found.append("refusal")
    asked = (form(item) or "") if item and item.strip() else ""
    copied = bool(asked) and copies(plain.lower(), asked.lower())
    if copied:
        found.append("copy")
    pair = last = None
    sentences: list[tuple[list[str], bool]] = []
    if state != "cut":
        tail = plain.rstrip(" \"'”»)")
        pieces = _END.split(plain)
        whole = len(pieces) - (not tail.endswith((".", "!", "?", "…")))
        said_words = [[x.lower() for x in _WORD.findall(p)] for p in pieces]
        if not copied:  # an item's endings say nothing of how reasonings end
            sentences = [(w if i < whole else w[:-1], i < whole) for i, w in enumerate(said_words) if w]
        if tail and tail[-1].isalnum() or tail.endswith((",", ";", ":", "-")):
            w = [x.lower() for x in _WORD.findall(tail)]
            pair, last = " ".join(w[-2:]), w[-1] if w else None
            if not tail[-1].isalnum():
                found.append("truncated")
                pair = last = None
    if asked:
        own = _QUOTED.sub(" ", plain)
        a, na, ra = language(own)
        b, nb, rb = language(asked)
        if a and b and a != b and na >= 2 and nb >= 3 and na >= 1.5 * ra and nb >= 1.5 * rb or other_script(_QUOTED.sub(" ", said or ""), item):
            found.append("language")
    return found, pair, last, sentences


#: Of several defects the first in this order names the run: what hides the judgement most.
ORDER = ["empty", "refusal", "copy", "truncated", "language"]


class Endings:
    """How often words and word pairs occur, and how often a sentence ends in them."""

    def __init__(self) -> None:
        self.n: Counter = Counter()
        self.ended: Counter = Counter()

    def add(self, sentences: list[tuple[list[str], bool]]) -> None:
        for w, ends in sentences:
            self.n.update(w)
            self.n.update(map(" ".join, zip(w, w[1:])))
            if ends:
                self.ended.update({w[-1], " ".join(w[-2:])})

    def rows(self) -> pd.DataFrame:
        """The counts so far, which start anew."""
        out = pd.DataFrame({"run_id": pd.Series([None] * len(self.n), dtype="Int64"), "found": None, "pair": None, "last": None, "key": list(self.n), "n": list(self.n.values()), "ended": [self.ended[k] for k in self.n]})
        self.__init__()
        return out


def may_end(pair_n: Column, pair_ended: Column, word_n: Column, word_ended: Column) -> Column:
    """Whether a sentence may end in a word pair, by its counts and those of its last word; NULL is never seen."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    word = (zero(word_ended) + WORD_SEEN * WORD_SHARE) / (zero(word_n) + WORD_SEEN)
    return (zero(pair_ended) + PAIR_SEEN * word) / (zero(pair_n) + PAIR_SEEN) >= END_SHARE


def defective_answers(runs: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, defect, defects) of the defective runs.

    ``runs`` has run_id, item_id, raw_outputs and logged_at; ``items`` id, text and ingested_at.
    """
    once = first_per_key(runs.filter(F.col("run_id").isNotNull()), ["run_id"], ["logged_at"], ["item_id", "raw_outputs"])
    # the final answer only; earlier attempts do not leave the scan's stage
    once = once.select("run_id", "item_id", F.try_element_at("raw_outputs", F.lit(-1)).alias("final"))
    text = first_per_key(items.filter("id is not null and text is not null"), ["id"], ["ingested_at"], ["text"])
    both = once.join(text.select(F.col("id").alias("item_id"), "text"), "item_id", "left").select("run_id", "final", "text")
    pairs = SparkSession.getActiveSession().sparkContext.broadcast(ConsistentForm.default().pairs)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, endings = _rewriter(pairs.value), Endings()
        for pdf in it:
            rows = [judge(f, t, form) for f, t in zip(pdf["final"], pdf["text"])]
            for r in rows:
                endings.add(r[3])
            yield pd.DataFrame({"run_id": pdf["run_id"], "found": [r[0] for r in rows], "pair": [r[1] for r in rows], "last": [r[2] for r in rows], "key": None, "n": 0, "ended": 0})
            if len(endings.n) > COUNTED_KEYS:
                yield endings.rows()
        if endings.n:
            yield endings.rows()

    # rows with a key are counts, the others runs
    judged = materialise(both.mapInPandas(run, "run_id long, found array<string>, pair string, last string, key string, n long, ended long"), "p5-judged")
    seen = judged.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    by_pair, by_word = (seen.select(F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("ended").alias(f"{k}_ended")) for k in ("pair", "last"))
    is_open = judged.filter("pair is not null").select("run_id", "found", "pair", "last").join(by_pair, "pair", "left").join(by_word, "last", "left")
    stops = is_open.select("run_id", F.when(may_end(*[F.col(c) for c in ("pair_n", "pair_ended", "last_n", "last_ended")]), F.col("found")).otherwise(F.array_append("found", F.lit("truncated"))).alias("found"))
    final = judged.filter("key is null and pair is null").select("run_id", "found").unionByName(stops).filter(F.size("found") > 0)
    first = F.filter(F.array(*[F.lit(x) for x in ORDER]), lambda x: F.array_contains(F.col("found"), x))[0]
    return final.select("run_id", first.alias("defect"), F.array_distinct("found").alias("defects"))
