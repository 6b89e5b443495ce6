"""Broken prompt and response pairs: a document and the questions written on it.

Prompt and response are aligned: the share of a response's 5-character shingles
that the document holds screens for copies, which are then aligned with a run of
whole sentences by their longest common subsequence; statements are aligned the
same way with templates of refusals, put together from words for declining, doing
and asking.  Languages are told apart by character trigrams, fitted on a bounded
sample of labelled texts.  Whether a question without a closing mark is complete
is learned from the whole corpus: questions that carry their mark show which
skeletons are complete, and one that has no such skeleton breaks off.

Defined results: a null or empty array is one ``empty`` row at position -1; null
elements and those of nothing but white space, invisible characters or a list
mark are ``empty``; a null or blank document only allows ``empty``, ``refusal``
and ``truncated``; repeated rows are judged on their own.  Order of precedence:
empty, refusal, copy, other_language, truncated.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.runtime import spill_table

from .batches import slices
from .nearcopies import gram_hashes

LIST_MARK = regex.compile(r"^[\s\p{Cf}]*(?:(?:\(?\p{N}{1,3}[.):]|[-*•·–—▪◦‣]|[Qq]\s?\p{N}{0,3}\s?[.:)]|[①-⑳])[\s\p{Cf}]*)?")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\sᅟᅠㅤﾠ]+")
END_MARK = re.compile(r"[\s.!?。！？।…\"”’»」』]+$")
QUESTION_END = re.compile(r"[?？]\s*[\"”’»」』)]*\s*$")
CUT_END = re.compile(r"(?:\.\.\.|…|[,;:、，\-–—])\s*$")

# Parts of refusal templates, a line for each kind: words of declining / doing / what is asked, in order, "|" between choices.
REFUSALS = """
i cannot|i can't|i can not|i won't|i will not|i am unable|i'm unable|i am not able|i'm not able|i must decline / write|create|produce|generate|form|make|help|answer|assist|comply|do
unable to|cannot|decline to / comply|answer|help|assist / request|passage|text|document|question|that
not enough|no enough|insufficient|too little / information|data|context|detail / question|questions|answer
no question|no questions|not possible / write|made|form|created|written|generated|drawn
request / outside|beyond|against / i can|policy|scope
no puedo|no podemos|no me es posible|no es posible|lamento no poder|soy incapaz de / redactar|escribir|crear|formular|generar|hacer|elaborar|ayudar|responder
no dispongo|no hay|no contiene|faltan|insuficientes / datos|información|contexto / pregunta|preguntas
kann ich|ich kann|können wir|lässt sich|lassen sich / keine frage|keine fragen|nicht helfen|nicht beantworten|nicht bearbeiten|nicht erstellen
nicht genug|nicht genügend|zu wenig|keine ausreichenden / angaben|informationen|daten / frage|fragen
anfrage|bitte / kann ich nicht|können wir nicht
질문|문제 / 만들|생성|작성|제시|도출 / 수 없|기 어렵|지 못
요청|질문|답변 / 처리|답변|응답|대답|도와 / 수 없|기 어렵|지 못
정보|내용|자료 / 부족
質問|問題 / 作|生成|作成 / できません|できない|かねます
依頼|要求|質問|リクエスト / 応|対応|答|処理 / かねます|できません|できない
情報|内容 / 不足|足り / 質問|問題
不能|无法|不可|没法 / 提出|生成|回答|处理|提供|编写 / 问题|请求|提问
信息|内容|资料 / 不足|不够 / 问题|提问
ไม่สามารถ|ไม่ได้ / ตั้ง|สร้าง|ตอบ|ช่วย / คำถาม|คำขอ|ข้อความ
ข้อมูล / ไม่เพียงพอ|ไม่พอ
प्रश्न|सवाल / नहीं / बना|लिख|सकता|सकती
जानकारी|सामग्री / नहीं|अपर्याप्त / प्रश्न|सवाल|है
"""

# Interrogatives, by which a Chinese question's skeleton is anchored.
CHINESE_ASKING = ("什么时候", "为什么", "什么", "多少", "哪里", "哪些", "哪", "怎么", "怎样", "如何", "几", "谁", "是否", "吗", "何")
ASKING = regex.compile(
    r"(?i)^(?:¿|who|what|when|where|which|why|how|whose|whom|did|do|does|is|are|was|were|can|in\s+(?:which|what|how)|at\s+(?:which|what)|by\s+(?:which|what|how)|to\s+(?:which|what)|under\s+(?:which|what)|from\s+(?:which|what)|between\s+which|"
    r"qué|cuál|cuáles|cuánt\p{L}+|cómo|cuándo|dónde|quién|quiénes|por\s+qué|(?:a|de|en|con|por|para)\s+(?:qué|cuál|cuánt\p{L}+|quién)|"
    r"wer|was|wann|wo|womit|warum|wie|welche\p{L}*|wessen|wem|wen|woher|wohin|wodurch|(?:in|an|auf|mit|von|bei|um|vor|zu)\s+(?:welche\p{L}*|wie))\b"
    r"|什么|为什么|多少|哪|怎|如何|几|谁|吗|何|どこ|なぜ|いつ|どの|だれ|どう|いくつ|무엇|언제|어디|어떻|얼마|누구|왜|며칠|몇"
)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)?")
_TOKEN = regex.compile(r"[\p{IsLatin}\p{N}\p{IsDevanagari}\p{M}]+|[\p{L}]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_QUOTES = "\"'“”„’‘«»「」『』"


@functools.lru_cache(maxsize=1)
def _unseen():
    """Format characters and quotation marks, which comparisons leave out."""
    return re.compile("[" + _QUOTES + "".join(re.escape(chr(c)) for c in itertools.chain(range(0x7F, 0x3000), range(0xFE00, 0x10000), range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) == "Cf") + "]")


def squash(text: str) -> str:
    """Lower case without white space, invisible characters and quotation marks."""
    if text.isascii():
        return "".join(text.lower().replace('"', "").replace("'", "").split())
    return "".join(_unseen().sub("", unicodedata.normalize("NFC", text).lower()).split())


def body_of(response: str) -> str:
    """The response without list mark and surrounding white space."""
    return LIST_MARK.sub("", response, count=1).strip()


# -- alignment ------------------------------------------------------------------------------------


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", text.lower()))


@functools.lru_cache(maxsize=1)
def _templates() -> dict[str, list[list[str]]]:
    """Templates by their last token: every choice of every part, in order."""
    out: dict[str, list[list[str]]] = {}
    for line in REFUSALS.strip().splitlines():
        for choice in itertools.product(*(part.split("|") for part in line.split(" / "))):
            tokens = [t for x in choice for t in _tokens(x)]
            out.setdefault(tokens[-1], []).append(tokens)
    return out


def is_refusal(response: str) -> bool:
    """A statement that holds all tokens of a refusal template in order, as their longest common
    subsequence. A question is none."""
    return declines(body_of(response))


def declines(body: str) -> bool:
    if QUESTION_END.search(body) or ASKING.match(body):
        return False
    tokens = _tokens(body)
    known, index = set(tokens), _templates()
    for last in known & index.keys():
        for t in index[last]:
            if known.issuperset(t) and lcs_length(t, tokens) == len(t):
                return True
    return False


#: Share of a response's shingles that the document holds, and of the longer text that is common in order, in a copy.
CONTAINED, ALIGNED = 0.9, 0.95
_SENTENCE = re.compile(r"[^.!?。！？।…\x00]*[.!?。！？।…\x00]+")


def contained(responses: list[str], docs: list[str], of: np.ndarray, n: int = 5) -> np.ndarray:
    """Share of each response's shingles found in its document (``of`` gives the document), all at once."""

    def hashes(texts, salt):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        h = gram_hashes(np.concatenate([*codes, np.zeros(n, np.uint32)]), n)
        many = np.maximum(size - n + 1, 0)
        at = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        with np.errstate(over="ignore"):
            return h[at] ^ np.repeat(salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), many), many

    have = np.sort(hashes(docs, np.arange(len(docs)))[0])
    mine, many = hashes(responses, of)
    out = np.zeros(len(responses))
    if len(have) and len(mine):
        hit = have[np.minimum(np.searchsorted(have, mine), len(have) - 1)] == mine
        upto = np.concatenate([[0], np.cumsum(hit)])
        end = np.cumsum(many)
        out = np.where(many > 0, (upto[end] - upto[end - many]) / np.maximum(many, 1), 0.0)
    for i in np.flatnonzero(many == 0).tolist():
        out[i] = float(responses[i] != "" and responses[i] in docs[of[i]])
    return out


def sentence_edges(doc: str) -> tuple[list[int], list[int]]:
    """Where sentences of a squashed document begin and where their letters end."""
    start, stop = [], []
    at = 0
    for m in _SENTENCE.finditer(doc + "\x00"):
        start.append(m.start())
        stop.append(m.start() + len(m.group(0).rstrip(".!?。！？।…\x00")))
        at = m.end()
    return start, stop


def is_aligned_copy(own: str, doc: str) -> bool:
    """A run of whole sentences of ``doc`` has at least ``ALIGNED`` of its letters in order in ``own``, and the other way round.

    Both are squashed; the runs tried are those that begin where a shingle of the
    response says it would begin.
    """
    starts, stops = sentence_edges(doc)
    tried = set()
    for k in range(0, max(1, len(own) - 4), max(1, len(own) // 4)):
        at = doc.find(own[k : k + 5])
        while at >= 0:
            i = min(range(len(starts)), key=lambda j: abs(starts[j] - (at - k)))
            j = min(range(len(stops)), key=lambda j: abs(stops[j] - (starts[i] + len(own))))
            if (i, j) not in tried and i <= j:
                tried.add((i, j))
                run = doc[starts[i] : stops[j]].replace("\x00", "")
                most = max(len(run), len(own))
                if min(len(run), len(own)) >= ALIGNED * most and lcs_length(list(own), list(run)) >= ALIGNED * most:
                    return True
            at = doc.find(own[k : k + 5], at + 1)
    return False


# -- languages ------------------------------------------------------------------------------------

#: Lengths of the strings that tell languages apart, their buckets, labelled texts that the languages are fitted on, and the words of each that count as common.
LENGTHS, BUCKETS, LABELLED, COMMON = (1, 3), 1 << 15, 5000, 50


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all ``n``-character strings of the lower-case texts (a blank at both ends, digits left out), and how many each text has."""
    codes = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = [c[(c < 48) | (c > 57)] for c in codes]
    size = np.array([len(c) for c in codes], np.int64)
    many = np.maximum(size - n + 1, 0)
    h = gram_hashes(np.concatenate([*codes, np.zeros(n, np.uint32)]), n)
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return ((h[at] >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64), many


class Languages:
    """Naive Bayes over single characters and trigrams; rows of a table are log chances by language.

    A twentieth of the chance is spread over all buckets, so that a string which no
    language has seen speaks for none.
    """

    def __init__(self, counts: dict[str, np.ndarray], words: dict[str, Counter]):
        self.names = sorted(counts)
        raw = np.array([counts[k] for k in self.names], float).reshape(len(self.names), len(LENGTHS), BUCKETS)
        chance = 0.95 * raw / np.maximum(raw.sum(2, keepdims=True), 1) + 0.05 / BUCKETS
        self.tables = [np.ascontiguousarray(np.log(chance[:, i]).T, np.float32) for i in range(len(LENGTHS))]
        self.common = {k: frozenset(w for w, _ in words[k].most_common(COMMON)) for k in self.names}

    def scores(self, texts: list[str], stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log chance in every language of every text, or of every run of ``stretch`` characters; and the text of each and the characters from it to the text's end."""
        parts = np.array([max(1, -(-(len(t) + 2) // stretch)) for t in texts], np.int64) if stretch else np.ones(len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), parts)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * (stretch or 0)
        out = np.zeros((len(owner), len(self.names)))
        for n, table in zip(LENGTHS, self.tables if self.names else ()):
            g, many = _grams(texts, n)
            begin = (np.cumsum(many) - many)[owner] + np.minimum(place, many[owner])
            end = np.append(begin[1:], len(g)) if len(begin) else begin
            some = np.flatnonzero(end > begin)
            if len(some):
                out[some] += np.add.reduceat(table[g], begin[some], axis=0)
        return out, owner, np.array([len(t) for t in texts], np.int64)[owner] - place

    @staticmethod
    def fit(labelled: DataFrame, lang: str, text: str) -> "Languages":
        """From at most ``LABELLED`` rows with a label and a text; few wrong labels do no harm."""

        def count(batches):
            counts, words = {}, {}
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = counts.setdefault(k, np.zeros((len(LENGTHS), BUCKETS), np.int64))
                    for i, n in enumerate(LENGTHS):
                        own[i] += np.bincount(_grams([t], n)[0], minlength=BUCKETS)
                    words.setdefault(k, Counter()).update(set(_WORD.findall(t.lower())))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((counts, {k: Counter(dict(c.most_common(COMMON))) for k, c in words.items()}))])], names=["model"])

        picked = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and trim(text) <> ''").limit(LABELLED)
        got = picked.repartition(1).mapInArrow(count, "model binary").first()
        return Languages(*pickle.loads(got[0])) if got else Languages({}, {})


#: Characters of a document whose language is told at once; share of them that makes a language the document's own;
#: how much likelier (in natural logs, and a character) a question must be in its own language than in one of those.
STRETCH, OWN_SHARE, MARGIN = 60, 0.1, 0.15


def languages_of(model: Languages, docs: list[str]) -> np.ndarray:
    """For every document and language, whether the language is the document's own."""
    own = np.zeros((len(docs), len(model.names)))
    if docs and model.names:
        score, owner, rest = model.scores(docs, STRETCH)
        # a run of nothing speaks for no language
        told = (np.ptp(score, axis=1) > 0) & (rest > 0)
        np.add.at(own, (owner[told], score[told].argmax(1)), np.minimum(rest, STRETCH)[told])
    return (own > 0) & (own >= OWN_SHARE * own.sum(1, keepdims=True))


# -- completeness ---------------------------------------------------------------------------------


def _cased(core: str) -> list[str]:
    return [("0" if w[0].isdigit() else w.lower() if i == 0 or not w[0].isupper() else "N") for i, w in enumerate(_WORD.findall(core))]


def skeletons(body: str, lang: str | None, common: frozenset, words) -> tuple[str, str | None]:
    """What makes a question of its kind complete, whatever it asks about; and, in Latin script, the same with
    runs of the document's own words (but for common ones and the last two) as one.

    Latin script: all words, runs of names as one; Chinese: the last interrogative
    and the last two characters; other scripts: the last two.
    """
    core = END_MARK.sub("", body).lstrip("¿¡ ")
    if len(_LATIN.findall(core)) * 2 > len(core.replace(" ", "")) or lang is None:
        tight = _cased(core)
        tight = [t for i, t in enumerate(tight) if not (t == "N" and i and tight[i - 1] == "N")]
        words = words()
        out: list[str] = []
        for i, t in enumerate(tight):
            k = "D" if i < len(tight) - 2 and t not in "N0" and t in words and t not in common else t
            if not (k == "D" and out and out[-1] == "D"):
                out.append(k)
        return f"{lang or 'xx'}|" + " ".join(tight), f"{lang or 'xx'}~" + " ".join(out)
    tight = "".join(core.split())
    if lang == "zh":
        hits = [(tight.rfind(w), -len(w), w) for w in CHINESE_ASKING if w in tight]
        return f"zh|{max(hits)[2] if hits else ''}|{tight[-2:]}", None
    return f"{lang}|{tight[-2:]}", None


_NAME_END = re.compile(r"[^\W\d_a-zß-ÿ][^\W\d_]*(?:\s+[^\W\d_a-zß-ÿ][^\W\d_]*)*$")


def name_breaks_off(body: str, document: str) -> bool:
    """The question ends inside a name: the document goes on with the word or the name wherever it has it."""
    m = _NAME_END.search(END_MARK.sub("", body))
    if not m or not m.group(0)[0].isupper() or not _LATIN.match(m.group(0)):
        return False
    tail, flat = " ".join(m.group(0).split()), " ".join(document.split())
    at, whole, longer = flat.find(tail), [], False
    while at >= 0:
        end = at + len(tail)
        if at == 0 or not flat[at - 1].isalpha():
            if end < len(flat) and (flat[end].isalpha() or unicodedata.combining(flat[end])):
                longer = True
            else:
                # the name goes on if the next word is capitalised and has a second letter
                whole.append(flat[end : end + 1] == " " and flat[end + 1 : end + 2].isupper() and flat[end + 2 : end + 3].isalpha())
        at = flat.find(tail, at + 1)
    return all(whole) if whole else longer


JUDGED = "row_id long, query_pos int, defect string, marked boolean, skeleton string, loose string, breaks_off boolean"


_JUDGED = pa.schema([("row_id", pa.int64()), ("query_pos", pa.int32()), ("defect", pa.string()), ("marked", pa.bool_()), ("skeleton", pa.string()), ("loose", pa.string()), ("breaks_off", pa.bool_())])


def _judge(model: Languages):
    def run(batches):
        for batch in slices(batches, "document"):
            out, left = [], []
            ids, docs = batch.column("row_id").to_pylist(), [d or "" for d in batch.column("document").to_pylist()]
            for i, queries in enumerate(batch.column("queries").to_pylist()):
                if not queries:
                    out.append((ids[i], -1, "empty", False, None, None, False))
                for pos, q in enumerate(queries or ()):
                    body = "" if q is None else body_of(q)
                    if not body or not body.isascii() and not INVISIBLE.sub("", body_of(INVISIBLE.sub(" ", q))):
                        out.append((ids[i], pos, "empty", False, None, None, False))
                    elif declines(body):
                        out.append((ids[i], pos, "refusal", False, None, None, False))
                    else:
                        left.append((i, pos, body))
            if left:
                of = np.array([i for i, _, _ in left])
                # empty lines are kept as boundaries
                tight = ["\x00".join(squash(p) for p in re.split(r"\n\s*\n", d) if p.strip()) for d in docs]
                own = [squash(END_MARK.sub("", b)) for _, _, b in left]
                near = contained(own, tight, of) >= CONTAINED
                own_languages, score = languages_of(model, docs), model.scores([b for _, _, b in left])[0]
                held: dict[int, set] = {}

                def words_of(i, held=held):
                    if i not in held:
                        held[i] = set(_WORD.findall(docs[i].lower()))  # noqa: B023
                    return held[i]

                for k, (i, pos, body) in enumerate(left):
                    if near[k] and is_aligned_copy(own[k], tight[i]):
                        out.append((ids[i], pos, "copy", False, None, None, False))
                        continue
                    marked, mine, lang = QUESTION_END.search(body) is not None, own_languages[i], None
                    if model.names:
                        best = int(score[k].argmax())
                        if mine.any() and not mine[best]:
                            if score[k][best] - score[k][mine].max() >= MARGIN * len(body) and (marked or ASKING.search(body)):
                                out.append((ids[i], pos, "other_language", marked, None, None, False))
                                continue
                            best = int(np.where(mine, score[k], -np.inf).argmax())
                        lang = model.names[best]
                    strict, loose = skeletons(body, lang, model.common.get(lang, frozenset()), functools.partial(words_of, i))
                    cut = CUT_END.search(body) is not None or not marked and name_breaks_off(body, docs[i])
                    out.append((ids[i], pos, None, marked, strict, loose, cut))
            cols = list(zip(*out)) if out else [[] for _ in _JUDGED]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _JUDGED)], schema=_JUDGED)

    return run


def broken_pairs(states: DataFrame, labelled: DataFrame, state_id: str = "state_id", document: str = "document", queries: str = "queries", *, lang: str = "lang", text: str = "text") -> DataFrame:
    """(state_id, query_pos, defect) of every defective pair.

    ``labelled`` has texts with the language of each, on a sample of which the
    languages are fitted.  Skeletons are complete when marked questions of the
    corpus have them; a kind of skeleton that is only an ending (scripts without
    cased words) must be marked more often than it is not.
    """
    rows = states.select(F.col(state_id).cast("long").alias("row_id"), F.col(document).alias("document"), F.col(queries).alias("queries"))
    judged = spill_table(rows.mapInArrow(_judge(Languages.fit(labelled, lang, text)), JUDGED), "pairs")
    usable = judged.where("defect is null and not breaks_off")
    # few skeletons hold many rows: counted before they are joined, so no key is hot on the right, and AQE splits hot left keys
    counts = usable.groupBy("skeleton").agg(F.count(F.when(F.col("marked"), 1)).alias("n"), F.count(F.when(~F.col("marked"), 1)).alias("bare"), F.max(F.col("loose").isNotNull()).alias("worded"))
    known = counts.where("n > 0 and (worded or n > bare)").select("skeleton", F.lit(True).alias("known"))
    loose = usable.where("marked and loose is not null").select("loose", F.lit(True).alias("known_loose")).distinct()
    open_ones = judged.where("defect is null and not marked or breaks_off")
    broken = open_ones.join(known, "skeleton", "left").join(loose, "loose", "left").where("breaks_off or (known is null and known_loose is null)").select("row_id", "query_pos", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("row_id", "query_pos", "defect").unionByName(broken).withColumnRenamed("row_id", state_id)
