"""Broken question-answer pairs: empty, refused, copied, in another language, or broken off.

Words are known that stand in a share of all documents, questions and answers. Languages: character n-gram naive Bayes, first
on a bounded sample of documents with their language labels (which may be wrong here and there), then twice more with all
questions and answers it is sure of. Ends of texts: for the last one to five words of every position of all answers
(numbers and names masked), how often a sentence ends there; an answer without a final stop whose last words hardly ever end
a sentence is broken off. Refusals: a logistic regression over word n-grams (names masked too) and whether the wording below is
found, fitted on a bounded sample of answers to abstention questions, most of which decline, and of other answers, few
of which do. Counts cover every row: tasks add them up in arrays of a fixed size, which are summed by blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, codepoints, materialize, slices

#: Documents with a label that the first language model is fitted on, about.
DOCUMENTS = 4_000
LANGUAGES = ("en", "de", "fr", "es", "zh")
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Texts a word must stand in to be known; log odds that make a language sure; share of ends below which a text is broken off; share of all
#: positions at which a context must have been seen.
KNOWN, SURE, ENDS, SEEN = 6, 3.0, 0.03, 1.3e-4
#: The same words in more texts: shares of all texts that a known word must stand in, and of all answers that a word must stand in before
#: their last word to end a text. The counts KNOWN and WHOLE hold where the shares come to less.
KNOWN_SHARE, WHOLE, WHOLE_SHARE = 3e-4, 2, 2 / 12_000
#: Answers to abstention questions, and other answers, that refusals are fitted on at most; buckets of their n-grams; shrinkage, steps and step size.
LABELLED, TERMS, SHRINK, STEPS, RATE = 8_000, 1 << 16, 1e-3, 200, 0.5
#: Where the fit begins: log odds of a refusal without and, added, with the wording. Without labelled answers they hold as they are.
PRIOR = (-1.0, 3.5)
#: Cells of each of the two rows of a count of words; blocks that arrays are summed in; fixed, whatever the corpus.
CELLS, BLOCKS = 1 << 20, 256

# fixed values: what stands in for an answer without being one
PLACEHOLDERS = {
    "null", "none", "nil", "nan", "na", "n a", "undefined", "empty", "blank", "missing", "tbd", "todo", "tba", "placeholder", "answer", "text", "answer text",
    "no answer text", "answer goes here", "your answer here", "insert answer here", "no answer provided", "no answer given", "no output", "no response", "no content", "no text",
    "empty answer", "empty string", "leer", "kein text", "keine antwort", "vide", "aucune reponse", "sans texte", "vacio", "sin respuesta", "sin texto", "待补充", "暂无", "空", "无",
}
# fixed values: how an answer declines or claims not to know, in the five languages; a feature of Refusals
REFUSING = regex.compile(
    r"""
    \b(?:can(?:no|')t|can\s+not|could(?:n't|\s+not)|unable|not\s+able|won't|will\s+not|would\s+not|decline[sd]?|refuse|rather\s+not|prefer\s+not)\b
    | \bno\s+way\s+of\s+know | \bno\s+(?:information|data|details?|records?|stored|memor(?:y|ies)|evidence|idea|clue|answer|mention)\b | \b(?:not|n't|isn't)\s+(?:contain|have|hold|provide)?\s*(?:enough|sufficient)
    | \bnothing\b.*\b(?:mention|context|tells|says|about)|\bnothing\s+here | \bonly\s+be\s+guess | \bis\s+silent\b | \bevidence\s+is\s+missing | \boutside\s+(?:of\s+)?what
    | \b(?:do|does|did)(?:n't|\s+not)\s+(?:know|say|mention|contain|cover|tell|have|include) | \b(?:isn't|not)\s+(?:possible|answerable|known|available|stated|mentioned|covered|recorded|sure) | \bimpossible\b | \bunanswerable\b | ^\W*unknown\W*$ | \bno\s+answer\b
    | \b(?:kann|kannst|darf|möchte|will|könnte)\b.*\bnicht | \bnicht\b.*\b(?:kann|darf|möchte|könnte)\b | \bweiß\b.*\bnicht | \bnicht\b.*\bweiß\b | \bkeine?r?n?\s+(?:auskunft|angaben?|informationen?|ahnung|daten|antwort|hinweise?|einzelheiten) | \bfehlen\b.*\b(?:angaben|daten|informationen) | \bmir\s+fehl
    | \breich(?:en|t)\s+nicht | \bsteht\b.*\bnichts | \blässt\s+sich\b.*\bnicht | \b(?:nichts\s+sagen|nicht\s+(?:beantwort|möglich|bekannt|ersichtlich)) | ^\W*unbekannt\W*$
    | \bne\s+(?:sais|sait|peux|peut|puis|suis|veux|souhaite|permet\w*|suffi\w*|di[ts]\w*|contien\w*|mentionn\w*|connais|trouve|dispose) | \bn'(?:ai|a|y\s+a|en\s+sais)\s+(?:aucun|pas|rien) | \baucune?\s+(?:information|donnée|idée|détail|note|mémoire|réponse) | \bimpossible\b | \bpréfère\s+ne | \brien\s+ici | \bil\s+manque | \bpas\s+en\s+mesure | ^\W*inconnue?\W*$
    | \bno\s+(?:lo\s+|la\s+|me\s+)?(?:sé|sabe|puedo|puede|tengo|estoy|basta\w*|permite\w*|hay|dispongo|consta|quiero|debo|contiene\w*|menciona\w*|figura|encuentro|es\s+posible) | \bprefiero\s+no | \bnada\s+(?:lo|la|aquí|de\s+esto)? ?menciona | \bfaltan?\b | \bimposible\b | \bsin\s+(?:datos|información|respuesta)\b | ^\W*desconocid[oa]\W*$
    | 无法 | 不能(?:回答|透露|说|确定|提供|告诉) | 不知道 | 不便 | 不清楚 | 不确定 | 没有.*(?:资料|信息|记录|记载|提到|答案|线索|内容) | 看不出 | 未(?:提到|提及|记载|知) | 不愿 | 拒绝回答
    """,
    regex.I | regex.X,
)
# fixed values: polite additions that answer nothing
FILLER = regex.compile(
    r"\b(?:could|can|would|might)\s+you\b|\bplease\s+(?:ask|share|provide|tell|give|check)|\bask\b.*\binstead|\bleave\s+it\s+open|\bbitte\b.*\bfragen|\bfragen\s+sie|\bfrag\s+|\bdemandez\b|\bpouvez-vous|\bpregunta|\bpodrías?\b|\bpuedes\b|请(?:去)?问|请提供|能否|可以.*吗"
    r"|^\W*(?:sorry|hm+|honestly|unfortunately|my\s+apologies|apologies|i'm\s+(?:sorry|afraid)|as\s+far\s+as\s+i\s+can\s+see|thanks\s+for\s+asking|as\s+an?\s+(?:ai\s+)?assistant|leider|verzeihung|ehrlich\s+gesagt|es\s+tut\s+mir\s+leid|tut\s+mir\s+leid|désolée?|hélas|à\s+vrai\s+dire|malheureusement|lo\s+siento|la\s+verdad|por\s+desgracia|lamentablemente|抱歉|对不起|很遗憾|老实说|很抱歉|but|aber|mais|pero|so|also|donc|así\s+que)(?:\W+(?:but|aber|mais|pero|so))?\W*$",
    regex.I,
)
# fixed values: how the languages are named in questions
NAMED = {
    "en": regex.compile(r"\benglish\b|\benglisch|\banglaise?s?\b|\binglés|\binglesa|英语|英文", regex.I),
    "de": regex.compile(r"\bgerman\b|\bdeutsch|\ballemande?s?\b|\balemán|\balemana|德语|德文", regex.I),
    "fr": regex.compile(r"\bfrench\b|\bfranzösisch|\bfrançaise?s?\b|\bfrancés|\bfrancesa|法语|法文", regex.I),
    "es": regex.compile(r"\bspanish\b|\bspanisch|\bespagnole?s?\b|\bespañol|西班牙", regex.I),
    "zh": regex.compile(r"\bchinese\b|\bmandarin\b|\bchinesisch|\bchinoise?s?\b|\bchin[oa]s?\b|中文|汉语|华语", regex.I),
}

TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{M}'’]+|\p{N}+|[^\s\p{L}\p{N}\p{M}]")
WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+")
STOPS, HANGING, CLOSERS = set(".!?。！？"), set(",;:(-–—/[{、，；：（&+=<"), "\"'”’»）)*_`]}」』 \t\r\n​\xa0"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@lru_cache(maxsize=1 << 17)
def cells_of(word: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return h % CELLS, CELLS + (h >> 32) % CELLS


def add_words(total: np.ndarray, sets) -> None:
    """Add sets of words to 2 * CELLS counts. Both cells of a word count at least the sets that hold it."""
    many: Counter[str] = Counter()
    for words in sets:
        many.update(words)
    for word, n in many.items():
        a, b = cells_of(word)
        total[a] += n
        total[b] += n


class Frequent:
    """The words that stand in `least` texts or more, by counts of add_words: none is missed, and few others share both cells with such words."""

    def __init__(self, counts: np.ndarray, least: float):
        self.enough = counts >= least

    def __contains__(self, word: str) -> bool:
        a, b = cells_of(word)
        return bool(self.enough[a] and self.enough[b])


class Languages:
    """Character n-gram naive Bayes over the known words of a text: unknown ones (names) tell nothing of the language."""

    def __init__(self, known: Frequent, counts: np.ndarray | None = None):
        """counts: (languages * BUCKETS) n-grams of the texts of each language, from add()."""
        self.known = known
        counts = 0.5 + (np.zeros(len(LANGUAGES) * BUCKETS) if counts is None else counts).reshape(len(LANGUAGES), BUCKETS)
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def add(self, total: np.ndarray, texts: list[str], weights: list[int], labels: list[int] | None = None) -> None:
        """Add the n-grams of texts, each `weight` times, to the counts of their languages; without labels, of those texts whose language is sure."""
        for a, b in slices(texts, len, 500_000):
            grams, owner = self._grams([r if r.strip() else "" for r in map(self.reduced, texts[a:b])])
            if labels is None:
                scores = self._sums(grams, owner, b - a)
                order = np.sort(scores, axis=1)
                best = np.where(order[:, -1] - order[:, -2] >= 2 * SURE, scores.argmax(axis=1), -1)
            else:
                best = np.array(labels[a:b])
            at, many = best[owner], np.array(weights[a:b])[owner]
            total += np.bincount((at * BUCKETS + grams)[at >= 0], weights=many[at >= 0], minlength=len(total)).astype(np.int64)

    def reduced(self, text: str) -> str:
        return " " + " ".join(w for w in words_of(text) if w in self.known) + " "

    @staticmethod
    def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of the texts, and which text each is from."""
        points, bounds = codepoints(texts)
        rolling, owner = Rolling(points), np.repeat(np.arange(len(texts)), np.diff(bounds))
        grams, owners = [], []
        for n in GRAMS:
            if len(points) < n:
                continue
            start = np.arange(len(points) - n + 1)
            start = start[owner[start] == owner[start + n - 1]]
            grams.append((rolling.of(start, start + n) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(owner[start])
        return (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def scores(self, texts: list[str]) -> np.ndarray:
        """(n, languages) log likelihoods, per n-gram order averaged; all 0 for a text without known words."""
        out = np.zeros((len(texts), len(LANGUAGES)))
        for a, b in slices(texts, len, 500_000):
            out[a:b] = self._sums(*self._grams([r if r.strip() else "" for r in map(self.reduced, texts[a:b])]), b - a)
        return out

    def _sums(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, weights=self.logs[k, grams], minlength=n) for k in range(len(LANGUAGES))], axis=1) / len(GRAMS)


class Endings:
    """How often a sentence ends after the last words of a text."""

    DEPTH, SLOTS = 5, 1 << 20
    #: Of the counts: ends and positions by slot, words before the last one, number of positions and texts.
    SIZE = 2 * SLOTS + 2 * CELLS + 2

    def __init__(self, known: Frequent, counts: np.ndarray | None = None):
        """counts: SIZE numbers from add()."""
        self.known = known
        counts = np.zeros(self.SIZE, np.int64) if counts is None else counts
        most = np.iinfo(np.int32).max
        self.end, self.all = (np.minimum(x, most).astype(np.int32) for x in (counts[: self.SLOTS], counts[self.SLOTS : 2 * self.SLOTS]))
        positions, texts = counts[-2:].tolist()
        self.whole = Frequent(counts[2 * self.SLOTS : -2], max(WHOLE, WHOLE_SHARE * texts))
        self.seen = max(8.0, SEEN * positions)

    def add(self, total: np.ndarray, texts: list[str]) -> None:
        for a, b in slices(texts, len, 500_000):
            keys, ended, inner = [], [], []
            for t in texts[a:b]:
                tokens = self.tokens(t.rstrip(CLOSERS))
                inner.append(set(tokens[:-1]))
                for i in range(1, len(tokens)):
                    if tokens[i] in STOPS:
                        continue
                    total[-2] += 1
                    found = self._keys(tokens, i)
                    keys += found
                    if i + 1 == len(tokens) or tokens[i + 1] in STOPS:
                        ended += found
            total[: self.SLOTS] += np.bincount(np.array(ended, np.int64), minlength=self.SLOTS)
            total[self.SLOTS : 2 * self.SLOTS] += np.bincount(np.array(keys, np.int64), minlength=self.SLOTS)
            add_words(total[2 * self.SLOTS : -2], inner)
            total[-1] += b - a

    def tokens(self, text: str) -> list[str]:
        out = ["^"]
        for t in TOKEN.findall(text):
            low = t.lower()
            if t[0].isnumeric():
                out.append("#")
            elif low in self.known or not t[0].isalpha():
                out.append(low)
            else:
                out.append("X" if t[0].isupper() else "?")
        return out

    def _keys(self, tokens: list[str], i: int) -> list[int]:
        """Slots of the contexts that end at token i, longest first. A short sentence has its shape (first word and length) before them."""
        out, text, shape = [], "", []
        for j in range(i, max(-1, i - self.DEPTH), -1):
            start = tokens[j] == "^" or tokens[j] in STOPS and j < i
            text = f"{'^' if start else tokens[j]} {text}"
            out.append(self._slot(text))
            if start:
                if 2 <= i - j <= 3:
                    shape = [self._slot(f"^{tokens[j + 1]}{i - j}")]
                break
        return shape + out[::-1]

    def _slot(self, text: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(text) % self.SLOTS

    def broken(self, text: str) -> bool:
        """Whether the text breaks off: hanging punctuation, or last words after which sentences hardly ever end."""
        text = text.rstrip(CLOSERS)
        while text.endswith("..") or text.endswith("…"):
            text = text.rstrip(".… ")
        if not text or text[-1] in STOPS:
            return False
        if text[-1] in HANGING:
            return True
        tokens = self.tokens(text)
        if len(tokens) == 2:
            return False
        if len(tokens) > 4 and tokens[-1].isalpha() and tokens[-1] not in ("X", "?") and tokens[-1] not in self.whole:
            return True
        keys = self._keys(tokens, len(tokens) - 1)
        known = [k for k in keys if self.all[k] >= self.seen]
        if not known:
            return tokens[-1] not in ("#", "X")
        rare = lambda k, share: bool(self.end[k] - 1 < share * self.all[k])  # noqa: E731  # the text itself may be one of the ends
        if len(tokens) <= 4:
            return rare(known[0], ENDS)
        # the longest context that is known well enough, or a shorter one of two words or more that is known very well
        return rare(known[0], ENDS) or any(self.all[k] >= 10 * self.seen and rare(k, ENDS / 3) for k in known if k != keys[-1])


def is_empty(parts: list[str]) -> bool:
    """Nothing that carries content: no letter or number, or only placeholders."""
    for p in parts:
        core = " ".join(regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"\p{M}", "", p.lower())))
        if core and core not in PLACEHOLDERS:
            return False
    return True


def is_refusal(text: str) -> bool:
    """Every part that says something declines or claims not to know."""
    seen = False
    for part in regex.split(r"[.!?;:。！？；：\n]+", text.replace("’", "'")):
        if REFUSING.search(part):
            seen = True
            continue
        words = WORD.findall(part)
        if not words or FILLER.search(part):
            continue
        if len(words) >= 3 or regex.search(r"\p{N}", part) or len(words) == 2 and seen:
            return False
    return seen


def _grams3(text: str) -> set[str]:
    import unicodedata

    core = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalnum())
    return {core[i : i + 3] for i in range(len(core) - 2)}


def is_copy(question: str, answer: str) -> bool:
    """The answer's wording is nearly all the question's, and is a good part of it: character 3-grams, blind to case, marks and spacing."""
    q, a = _grams3(question), _grams3(answer)
    if len(a) < 12 or not q:
        return False
    common = len(q & a)
    return common >= 0.72 * len(a) and common >= 0.3 * len(q)


class Refusals:
    """Probability that an answer declines, from word n-grams and the wording above as one feature among them."""

    PIECE = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:['’]\p{L}+)?|\p{N}+")

    def __init__(self, known: Frequent):
        self.known, self.base, self.worded, self.weights = known, *PRIOR, np.zeros(TERMS)

    def _terms(self, text: str) -> np.ndarray:
        import xxhash

        words = ["^"]
        for w in self.PIECE.findall(text):
            words.append("#" if w[0].isnumeric() else w.lower() if all(x in self.known for x in words_of(w)) else "X")
        words.append("$")
        return np.array(sorted({xxhash.xxh64_intdigest("_".join(words[i : i + n])) % TERMS for n in (1, 2, 3) for i in range(len(words) - n + 1)}))

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of all texts, text of each, weight of a text's terms, whether the wording is found)."""
        found = [self._terms(t) for t in texts]
        many = np.array([len(x) for x in found])
        return np.concatenate(found), np.repeat(np.arange(len(texts)), many), 1 / np.sqrt(many), np.array([is_refusal(t) for t in texts], dtype=float)

    def fit(self, declining: list[str], others: list[str]) -> Refusals:
        """Both kinds weigh the same, however many there are. The labels are those of the questions, so a share of them is wrong on both sides."""
        if not declining or not others:
            return self
        terms, row, scale, worded = self._rows(declining + others)
        n = len(declining) + len(others)
        y = np.repeat([1.0, 0.0], [len(declining), len(others)])
        share = np.repeat([0.5 / len(declining), 0.5 / len(others)], [len(declining), len(others)])
        seen, seen_two = np.full(TERMS, 1e-8), np.full(2, 1e-8)
        for _ in range(STEPS):
            z = self.base + self.worded * worded + np.bincount(row, weights=self.weights[terms], minlength=n) * scale
            error = (1 / (1 + np.exp(-z)) - y) * share
            g = np.bincount(terms, weights=(error * scale)[row], minlength=TERMS) + SHRINK * self.weights
            seen += g * g
            self.weights -= RATE * g / np.sqrt(seen)
            two = np.array([error.sum(), (error * worded).sum()])
            seen_two += two * two
            self.base, self.worded = np.array([self.base, self.worded]) - RATE * two / np.sqrt(seen_two)
        return self

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        terms, row, scale, worded = self._rows(texts)
        return 1 / (1 + np.exp(-(self.base + self.worded * worded + np.bincount(row, weights=self.weights[terms], minlength=len(texts)) * scale)))


class Judge:
    def __init__(self, languages: Languages, endings: Endings, refusals: Refusals):
        self.languages, self.endings, self.refusals = languages, endings, refusals

    def judge(self, questions: list[str | None], answers: list[list[str | None] | None], abstention: list[bool]) -> list[str | None]:
        """The defect of each pair, None where there is none. Without a question, only empty, refusal and truncated can come out."""
        parts = [[p for p in a or [] if p] for a in answers]
        whole = [" ".join(p) for p in parts]
        ask, say = self.languages.scores([q or "" for q in questions]), self.languages.scores(whole)
        declines = self.refusals.probabilities(whole) >= 0.5
        out: list[str | None] = []
        for i, (q, p, text) in enumerate(zip(questions, parts, whole)):
            if is_empty(p):
                out.append("empty")
                continue
            if declines[i]:
                out.append(None if abstention[i] else "refusal")
                continue
            if q and is_copy(q, text):
                out.append("copy")
                continue
            if q and ask[i].any() and say[i].any():
                here, best = int(ask[i].argmax()), int(say[i].argmax())
                if best != here and say[i, best] - say[i, here] >= SURE and not NAMED[LANGUAGES[best]].search(q):
                    out.append("other_language")
                    continue
            out.append("truncated" if self.endings.broken([x for x in p if x.strip()][-1]) else None)
        return out


def pairs_of(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """(record_kind, record_id, question, answer array<string>, abstention): each sample and each reader output once, the output with its sample's question."""
    s = samples.where("question_id is not null").groupBy("question_id").agg(F.min_by(F.struct("question", "answer"), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("s"))
    s = s.select("question_id", "s.question", "s.answer")
    o = outputs.where("output_id is not null").groupBy("output_id").agg(F.min_by(F.struct("question_id", "answer"), F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp"))).alias("o"))
    o = o.select("output_id", "o.question_id", "o.answer").join(s.select("question_id", "question"), "question_id", "left")
    absent = F.coalesce(F.lower("question_id").endswith("_abs"), F.lit(False)).alias("abstention")
    one = s.select(F.lit("sample").alias("record_kind"), F.col("question_id").alias("record_id"), "question", "answer", absent)
    return one.unionByName(o.select(F.lit("reader").alias("record_kind"), F.col("output_id").alias("record_id"), "question", F.array("answer").alias("answer"), absent))


def _taken(df: DataFrame, most: int, *key: str) -> list:
    """About `most` rows (1.2 times as many at most), those of the smallest hashes of their key: every task sends its share only."""
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    share = min(1.0, most / max(1, df.count()))
    return df.where(h < int(share * (1 << 30))).limit(most + most // 5).collect()


def summed(df: DataFrame, size: int, add) -> np.ndarray:
    """`size` counts over all rows: add(total, batch) adds those of a batch; tasks send one array each, in BLOCKS blocks, and blocks are summed."""
    width = -(-size // BLOCKS)

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            add(total, batch)
        parts = [(b, total[b * width : (b + 1) * width]) for b in range(BLOCKS)]
        rows = [(b, zlib.compress(x.tobytes(), 1)) for b, x in parts if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "counts"])

    def merge(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(size, dtype=np.int64)
    for r in df.mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(merge, "block int, counts binary").collect():  # BLOCKS rows of a fixed size
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def fit(documents: DataFrame, pairs: DataFrame) -> Judge:
    """Fit the models: counts over all documents, questions and answers; only labelled rows are samples, by hash of their ids: about DOCUMENTS
    documents with a language, and LABELLED answers to each kind of question.
    """
    spark = documents.sparkSession
    label = F.lower(F.substring("lang", 1, 2))
    docs = _taken(documents.where(label.isin(*LANGUAGES) & F.col("text").isNotNull()).select("doc_id", "text", label.alias("lang")), DOCUMENTS, "doc_id")
    questions = pairs.where("question <> ''").groupBy(F.col("question").alias("text")).agg(F.count("*").alias("n")).withColumn("said", F.lit(False))
    answers = pairs.select(F.explode("answer").alias("text")).where("text <> ''").select("text", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("said"))
    texts = materialize(questions.unionByName(answers), "defect-texts")

    def words(total, batch):
        found = batch.column(0).to_pylist()
        add_words(total[:-1], (set(words_of(t)) for t in found))
        total[-1] += len(found)

    counts = summed(documents.where("text is not null").select("text").unionByName(texts.select("text")), 2 * CELLS + 1, words)
    known = Frequent(counts[:-1], max(KNOWN, KNOWN_SHARE * counts[-1]))
    blank = spark.sparkContext.broadcast(Endings(known))
    endings = Endings(known, summed(texts.where("said").select("text"), Endings.SIZE, lambda total, batch: blank.value.add(total, batch.column(0).to_pylist())))
    model, size = Languages(known), len(LANGUAGES) * BUCKETS
    first = np.zeros(size, np.int64)
    model.add(first, [r.text for r in docs], [1] * len(docs), [LANGUAGES.index(r.lang) for r in docs])
    model = Languages(known, first)
    for _ in range(2):
        shared = spark.sparkContext.broadcast(model)
        own = np.zeros(size, np.int64)
        model.add(own, [r.text for r in docs], [1] * len(docs))
        every = summed(texts.select("text", "n"), size, lambda total, batch, shared=shared: shared.value.add(total, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        model = Languages(known, own + every)
    told = pairs.where("answer is not null").select("record_id", F.concat_ws(" ", F.filter("answer", lambda a: F.coalesce(a, F.lit("")) != "")).alias("text"), "abstention").where("text <> ''")
    sides = [[r.text for r in _taken(told.where(F.col("abstention") == x), LABELLED, "record_id") if not is_empty([r.text])] for x in (True, False)]
    return Judge(model, endings, Refusals(known).fit(*sides))


def defects(documents: DataFrame, samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """(record_kind, record_id, defect) of each defective sample and reader output; at most one row each.

    Null or empty answers, and arrays without a text, are 'empty'. A record delivered again counts once, as first delivered.
    An output whose sample is missing is judged without a question. Whole texts are judged.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # judging costs far more than reading, so pairs are dealt to that many tasks whatever their bytes
    pairs = materialize(pairs_of(samples, outputs).repartition(n, "record_id"), "defect-pairs")
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, pairs))  # models of a fixed size

    def run(batches):
        judge = shared.value
        for batch in batches:
            c = batch.to_pydict()
            found = judge.judge(c["question"], c["answer"], c["abstention"])
            keep = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(found, pa.string()).take(keep)], ["record_kind", "record_id", "defect"])

    return pairs.mapInArrow(run, "record_kind string, record_id string, defect string")
