"""Problem 2: broken question-answer pairs by noisy labelling functions and an expectation-maximization label model."""

from __future__ import annotations

import ast
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import PLAIN, WORD, cut, first_per_key, mix64, spread, words
from .endings import HEADS, SAMPLE, TOKEN, EndModel, bare, finished, fit, last_token, sample_texts, strip_end, whole_words
from .labelmodel import fit as fit_labels

#: Posteriors from which a defect is kept where none can be validated; a record keeps several labels in defect_labels.
#: Where only one may be given, the first in this order is taken.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copied_question": 0.5, "other_language": 0.5, "truncated": 0.5}
#: Cutoffs that are tried, and the planted defects from which one is chosen by them.
LEAST, TRIED = 20, [0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9]

# Answers that hold no content.
PLACEHOLDERS = frozenset(
    ["n a", "na", "null", "none", "nan", "nil", "tbd", "tba", "todo", "empty", "blank", "undefined", "unknown", "no answer", "not available", "not applicable", "answer", "your answer here", "placeholder", "missing", "no data", "to be determined", "to be done", "x", "xx", "xxx", "fixme", "void", "no response", "insert answer here", "lorem ipsum"]
)
# Frequent function words by language.
STOPWORDS = {
    "en": "the a an and of to in is it that this with for on at by from as are was were which what how when while there be or not so its then who does into under over near".split(),
    "es": "el la los las un una y de del que en es con por para se lo como más pero sin al su muy casi sobre tras bajo entre qué cómo cuando mientras hasta tan dónde primero también no".split(),
    "fr": "le la les un une et de du des que en est avec pour dans sur se plus mais sans au aux sa son très près sous entre comment quand tandis peu qui où après derrière même par il à d'abord puis".split(),
    "de": "der die das ein eine einen einem einer und in im ist mit für auf von zu den dem nicht sich als auch es an bei nach aus wie wenn während hinter unter gegen ohne sehr ganz immer kurz darauf".split(),
    "pt": "o a os as um uma e de do da que em no na é com por para se mais mas sem ao sua seu muito quase sobre depois sob entre como quando enquanto uns umas pouco perto até atrás à não".split(),
    "it": "il lo la gli le un una e di del della che in è con per si più ma senza al sua suo molto quasi sopra dopo sotto tra come quando mentre dove poco vicino non".split(),
    "nl": "de het een en van in is dat op te met voor niet zijn er aan als om bij uit naar maar door over ook wordt".split(),
    "ru": "и в на с по не из за под что как это когда пока без у к до над при все всё даже очень почти а же возле через после потом где".split(),
}
#: Languages that function words tell, by the value that the table of words has for them, less one.
LANGUAGES = sorted(STOPWORDS)
#: By function word: a bit for each language that has it.
SPOKEN = {w: sum(1 << i for i, k in enumerate(LANGUAGES) if w in STOPWORDS[k]) for v in STOPWORDS.values() for w in v}
RU = LANGUAGES.index("ru")
# Words of which an answer must hold one for any of the patterns below to fit; of other scripts all are tried.
DECLINING = frozenset("i we no outside beyond possible consult request answer response can cant cannot unable not won wont ai language text assistant virtual prefiero modelo je tant impossible ich sprachmodell ki ablehnen möglich kann não prefiro non preferisco".split())
DECLINING_ONCE = frozenset("nothing against".split())
OFFERING = frozenset("rephrase different transcript know sensitive human try anything".split())
SPEAKING = frozenset("say says said refuse refuses decline declines apologise apologises apologised apologize apologizes apologized apologising apologizing cannot can answer answers".split())
PERSONS = frozenset("he she they someone".split())
FIRST = frozenset("i me my we our".split())
#: By word: a bit for each set that has it.
ROLE_SETS = (DECLINING, DECLINING_ONCE, OFFERING, SPEAKING, FIRST)
ROLES = {w: sum((w in x) << i for i, x in enumerate(ROLE_SETS)) for v in ROLE_SETS for w in v}
# Ways to decline by the words of DECLINING_ONCE; REFUSALS has them as well.
DECLINED_ONCE = [
    r"\b(?:no|nothing) (?:comment|answer|reply) (?:can|could|will) be (?:made|given)",
    r"\bgo(?:es)? against (?:my|our|the) (?:guidelines|policy|policies|rules|principles)",
]
REFUSALS_ONCE = re.compile("|".join(DECLINED_ONCE), re.I)
# Ways to decline, by the start of a clause or anywhere outside quotations.
REFUSALS = re.compile(
    "|".join(
        [
            r"\b(?:i|we) (?:really )?(?:can ?not|can'?t|could not|couldn'?t|won'?t|will not|would not|wouldn'?t|do not|don'?t|am not|'m not|was not|wasn'?t) (?:be )?(?:able|allowed|permitted|going|help|assist\w*|answer|discuss|provide|comply|comment|respond|listen|hear|evaluate|judge|analy[sz]e|access|process|fulfil\w*|have (?:access|the ability|permission)|built|made|designed|trained|in a position|comfortable|feel comfortable|do that|say|share|give|offer|describe|determine)",
            r"\bi(?:'m| am) (?:not able|unable|choosing not|sorry|afraid|declining|not (?:allowed|permitted|comfortable|built|designed|in a position))",
            r"\bi (?:must|have to|need to|would like to|will|shall) (?:refuse|decline|pass|abstain|refrain|skip)",
            r"\bi(?:'d| would) (?:rather|prefer) not\b",
            r"\bi (?:refuse|decline)\b",
            r"\bsomething i (?:must|have to|can'?t|cannot)\b",
            *DECLINED_ONCE,
            r"\bfalls? outside (?:of )?what i\b|\b(?:outside|beyond) my (?:scope|abilities|capabilities)",
            r"\bno way (?:that )?i (?:could|can)\b",
            r"\b(?:it )?(?:isn'?t|is not) possible for me\b",
            r"\bconsult (?:a|an) (?:human|expert|professional)",
            r"\brequest (?:declined|denied|refused)|\b(?:answer|response) (?:declined|denied|refused|withheld)",
            r"^\W*(?:sorry,? )?(?:can'?t|cannot|can not|unable to|not able to|won'?t) (?:assist|help|answer|comply|do|provide|comment|respond)",
            r"\bas an? (?:ai|language model|text model|assistant)\b|\bbeing an? (?:text|ai|language|virtual) (?:assistant|model)\b",
            r"\bno (?:puedo|podré|me es posible|estoy autorizad[oa]|tengo permitido|soy capaz)\b|\bprefiero no\b|\bcomo modelo de (?:lenguaje|idioma)\b|\bno me está permitido\b",
            r"\bje ne (?:peux|pourrai|suis|sais|souhaite|veux) (?:pas|malheureusement)|\bje préfère ne pas\b|\ben tant que modèle\b|\bje refuse\b|\bimpossible pour moi\b|\bje dois (?:refuser|décliner)|\bil m'est impossible\b",
            r"\bich (?:kann|darf|möchte|werde)\b[^.!?]{0,60}\b(?:nicht|keine?n?)\b|\bkann ich\b[^.!?]{0,60}\b(?:nicht|keine?n?)\b|\bals (?:sprachmodell|ki)\b|\bmuss ich ablehnen\b|\bist mir nicht möglich\b",
            r"\bnão (?:consigo|posso|me é possível|estou autorizad[oa]|tenho permissão|sou capaz)\b|\bprefiro não\b|\bcomo modelo de linguagem\b|\bnão poderei\b",
            r"\bnon (?:posso|sono in grado|mi è possibile)\b|\bpreferisco non\b",
            r"не могу|не имею права|не в состоянии|вынужден\w* отказать|как языковая модель|не буду отвечать|отказываюсь|не смогу",
            r"我(?:无法|不能|没有办法|不便|拒绝)|无法(?:回答|提供|协助|帮助|满足|判断|评论|处理)|不能(?:回答|提供|协助|帮助)|作为(?:一个)?(?:语言模型|人工智能|ai)|恕(?:我)?(?:无法|不能)|不便(?:回答|评论)",
            r"できません|できかねます|お答えできない|お断り|対応できない|言語モデルとして|お手伝いできない|差し控え|いたしかねます|わかりかねます",
            r"할 수 없습니다|답변(?:할 수|드릴 수) 없|도와드릴 수 없",
        ]
    ),
    re.I,
)
# Refusals to plant.
DECLINED = ["I'm sorry, but I can't help with that.", "I cannot answer this question about the clip.", "I would rather not comment on that request.", "As a language model, I am not able to listen to audio.", "Unfortunately I must decline to answer.", "Lo siento, pero no puedo responder a eso.", "抱歉，我无法回答这个问题。"]
EMPTIED = ["", " ", "N/A", "<answer></answer>", *sorted(PLACEHOLDERS)]
APOLOGY = re.compile(r"^\W*(?:(?:i'?m |i am |we'?re |so |very |my )?(?:sorry|apolog\w+)|unfortunately|regretfully|regrettably|with respect|lo siento|lamentablemente|perdón|disculp\w+|désolée?|je suis désolée?|malheureusement|je regrette|tut mir leid|es tut mir|leider|entschuldig\w+|desculp\w+|infelizmente|lamento|sinto muito|mi dispiace|извините|простите|к сожалению|抱歉|很抱歉|对不起|遗憾|申し訳|すみません|恐れ入りますが|残念ながら|죄송)", re.I)
OFFER = re.compile(r"\b(?:rephrase|something different|provide a transcript|let me know if|may be sensitive|human expert|try (?:another|a different)|anything else)\b", re.I)
THIRD = re.compile(r"^\W*(?:the|an?|one|some|this|that|her|his|their|another)\b[^.!?]*?\b(?:speakers?|voices?|man|woman|narrator|person|child|host|caller|singer|boy|girl|someone|actor|recording|clip)\b[^.!?]*?\b(?:says?|said|refuses?|declines?|apologi\w+|cannot|can'?t|answers?)\b|^\W*(?:he|she|they|someone)\b", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|『[^』]*』|‘[^’]*’")
CHOICES = re.compile(r"\n\s*(?:choices|options)\s*:?\s*\n|\n\s*A[.)] ", re.I)
ASKING = re.compile(r"^\W*(?:q(?:uestion)?\s*[:.]|(?:so,? )?(?:you(?:'re| are) asking|the question (?:is|was|asks)|you asked|question|let me repeat|to repeat|repeat(?:ing)? the question)[^:]{0,20}:)\s*", re.I)
TAGS = re.compile(r"</?[a-z_]{1,20}>", re.I)
DANGLING = frozenset("a an the and or but of to in with by for from as that which so while until than because if when at on into nor plus like very un una el la los las de del y que con en le les des du et à au ein eine der die das den dem und mit im am o os as um uma do da e com em no na и в на с по the".split())


SLICE = 2048


class Scripts(dict):
    """The script of each letter, None for other characters; filled as characters are met."""

    def __missing__(self, c: str) -> str | None:
        o = ord(c)
        name = None
        if c.isalpha():
            name = "kana" if 0x3040 <= o < 0x3100 else "han" if 0x3400 <= o < 0xA000 else "hangul" if 0xAC00 <= o < 0xD7A4 else "cyrillic" if 0x400 <= o < 0x530 else "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "arabic" if 0x600 <= o < 0x700 else unicodedata.name(c, "?").split()[0]
        self[c] = name
        return name


SCRIPTS = Scripts()


def script(text: str) -> str | None:
    """The most frequent script of the letters of a text."""
    if text.isascii():
        return "latin" if LETTER.search(text) else None
    seen = Counter(map(SCRIPTS.__getitem__, text))
    seen.pop(None, None)
    if seen["kana"] and seen["kana"] * 8 >= seen["han"] and seen["kana"] + seen["han"] >= max(seen.values()):
        return "kana"
    return seen.most_common(1)[0][0] if seen.total() else None


LETTER = re.compile(r"[A-Za-z]")
#: Scripts that tell the language by themselves.
OWN = {"kana": "ja", "han": "zh", "hangul": "ko"}
CODES = {k: i for i, k in enumerate([*LANGUAGES, *OWN.values()])}


class Words(dict):
    """Codes of words, and by code what is known of each word."""

    def __init__(self, languages_of=None):
        super().__init__()
        self.languages_of, self.new = languages_of, []
        self.spoken, self.own, self.roles = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n

    def of(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words, and the list each belongs to."""
        sizes = [len(p) for p in parts]
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        if self.new:
            self.spoken = np.r_[self.spoken, np.array([SPOKEN.get(w, 0) for w in self.new], np.uint16)]
            if self.languages_of:
                self.own = np.r_[self.own, self.languages_of(self.new)]
            self.roles = np.r_[self.roles, np.array([ROLES.get(w, 0) for w in self.new], np.uint8)]
            self.new = []
        return flat, np.repeat(np.arange(len(parts)), sizes)

    def fresh(self) -> None:
        if len(self) > 300_000:
            self.clear()
            self.spoken, self.own, self.roles = self.spoken[:0], self.own[:0], self.roles[:0]


def languages(scripts: list[str | None], flat: np.ndarray, owner: np.ndarray, spoken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: the code of its language by script or function words, -1 if it can't be told, and how many of these were
    seen."""
    n = len(scripts)
    hit = np.flatnonzero(spoken[flat])
    masks, who = spoken[flat[hit]], owner[hit]
    counts = np.stack([np.bincount(who, masks >> i & 1, n) for i in range(len(LANGUAGES))], 1) if n else np.zeros((0, len(LANGUAGES)))
    cyrillic = np.array([s == "cyrillic" for s in scripts], bool)
    counts[~cyrillic, RU] = 0
    counts[np.ix_(cyrillic, [i for i in range(len(LANGUAGES)) if i != RU])] = 0
    best = counts.argmax(1) if n else np.zeros(0, np.int64)
    top = counts.max(1, initial=0).astype(np.int64)
    tied = (counts == top[:, None]).sum(1) > 1
    lang = np.where((top > 0) & ~tied, best, -1)
    top = np.where(lang >= 0, top, 0)
    lang, top = np.where(cyrillic & (lang < 0), RU, lang), np.where(cyrillic & (lang < 0), 1, top)
    for i, s in enumerate(scripts):
        if s in OWN:
            lang[i], top[i] = CODES[OWN[s]], 9
    return lang, top


def language(text: str) -> tuple[str | None, int]:
    """Language of one text and how many function words tell it."""
    known = Words()
    flat, owner = known.of([words(text)])
    lang, n = languages([script(text)], flat, owner, known.spoken)
    return (list(CODES)[lang[0]] if lang[0] >= 0 else None), int(n[0])


@dataclass
class Models:
    ends: EndModel
    words: lexicon.Table

    def word_languages(self, words: list[str]) -> np.ndarray:
        """The values of the languages that words belong to, 0 of those that belong to none."""
        return self.words.get_all(words)


def tally(texts: list[str]) -> Iterator[tuple[str, list[str] | Counter[str]]]:
    """Words of the texts for the ending model; and each word of a text once, under the text's language if that is known,
    counted."""
    parts = [words(t) for t in texts]
    sizes = [len(p) for p in parts]
    spoken = np.fromiter(map(SPOKEN.get, chain.from_iterable(parts), repeat(0)), np.uint16, sum(sizes))
    hit = np.flatnonzero(spoken)
    lang, n = languages([script(t) for t in texts], hit, np.repeat(np.arange(len(parts)), sizes)[hit], spoken)
    by: dict[str, list[set[str]]] = {}
    for t, p, k, c in zip(texts, parts, lang.tolist(), n.tolist()):
        yield "", whole_words(t)
        if 0 <= k < len(LANGUAGES) and c >= 2:
            by.setdefault(LANGUAGES[k], []).append(set(p))
    for k, sets in by.items():
        count = Counter(chain.from_iterable(sets))
        for w in [w for w in count if w.isnumeric()]:
            del count[w]
        yield k, count


def train(texts: list[str], corpus: DataFrame) -> Models:
    """Ending model, its weights fitted on a bounded sample of texts; words and those that belong to one language are
    counted over all different texts of corpus."""
    counts = lexicon.count_words(corpus, tally)
    plain, best = counts.filter("list = ''"), F.max(F.struct("n", "list"))
    by = counts.filter("list <> ''").groupBy("word").agg(F.sum("n").alias("total"), best.alias("best"))
    code_of = F.create_map(*[F.lit(x) for i, k in enumerate(LANGUAGES, 1) for x in (k, i)])
    one = by.filter("best.n >= 3 and best.n >= 0.9D * total").select("word", code_of[F.col("best.list")].alias("v"))
    words = lexicon.known_table(plain), frozenset(lexicon.most_frequent(plain, HEADS))
    return Models(fit(texts, words=words), lexicon.value_table(one))


#: Labelling functions by defect. Each looks at something of its own, and abstains where that says nothing.
RULES = {
    "empty": ["letters", "placeholder", "tags", "length"],
    "refusal": ["declines", "apology", "offer", "third_person", "no_first_person"],
    "copied_question": ["words_from_question", "runs_from_question", "question_covered", "asks"],
    "other_language": ["function_words", "script", "vocabulary", "thinking"],
    "truncated": ["ending", "choice_prefix", "word_broken", "last_word"],
}
SENTENCE_WORDS = re.compile(r"[^\W_]+|[.!?。？！]")
SENTENCE_ENDS = frozenset(".!?。？！")
MARKED = PLAIN | {ord(x): "." for x in ".!?"}
QUOTES = frozenset("\"“”«»„「」『』‘’")
Record = tuple[str, str, str, list[tuple[str, str]]]
QuestionSide = tuple[str | None, int, int]
AnswerSide = tuple[str | None, int, bool, bool, int, int, bool]
shown = lru_cache(1 << 16)(repr)
#: What is planted in a record: by defect the pattern of its votes, and both sides of what an answer in another language,
#: which is another record's, is judged by.
PLANTS = {"empty": "int", "refusal": "int", "copied_question": "int", "truncated": "int", "asked": "string", "told": "string"}
Planted = dict[str, int | str | None]


def nth(keys: np.ndarray) -> np.ndarray:
    """How often the same key stands before each, among all."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.arange(len(k))
    start = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    out = np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(start, at, 0))
    return out


def grams(flat: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k codes within a text, the text's number mixed in, and whose they are."""
    m = len(flat) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix64(owner[:m].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(k):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + flat[i : i + m].astype(np.uint64))
    keep = owner[:m] == owner[k - 1 :]
    return h[keep], owner[:m][keep]


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b."""
    if not len(b):
        return np.zeros(len(a), bool)
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Copies:
    """How much of the answers comes from their questions: shares of words and of runs, and of a sentence's words."""

    def __init__(self, n: int, answer: tuple[np.ndarray, np.ndarray], question: tuple[np.ndarray, np.ndarray], stem: tuple[np.ndarray, np.ndarray], sentence: np.ndarray, run: int):
        key = lambda part, times: part[1] << 44 | part[0] << 20 | np.minimum(times, (1 << 20) - 1)
        whose = lambda part: nth(part[1] << 24 | part[0])
        asked = key(answer, whose(answer))
        size = np.maximum(np.bincount(answer[1], minlength=n), 1)
        self.inside = np.bincount(answer[1], among(asked, key(question, whose(question))), n) / size
        (ha, oa), (hq, _) = grams(*answer, run), grams(*question, run)
        self.runs = np.bincount(oa, among(ha, hq), n) / np.maximum(np.bincount(oa, minlength=n), 1)
        count = int(sentence.max(initial=-1)) + 1
        length = np.bincount(sentence, minlength=count)
        held = np.bincount(sentence, among(key(stem, nth(sentence << 24 | stem[0])), asked), count)
        self.covered = np.zeros(n)
        np.maximum.at(self.covered, stem[1], np.where(length >= 4, held / np.maximum(length, 1), 0.0)[sentence])

    def votes(self, i: int, asks: bool) -> list[int]:
        side = lambda x, high, low: 1 if x >= high else -1 if x <= low else 0
        return [side(self.inside[i], 0.85, 0.65), side(self.runs[i], 0.6, 0.3), side(self.covered[i], 0.8, 0.5), int(asks)]


class Voter:
    """Votes of all labelling functions on batches of records: 1 for the defect, -1 against it, 0 no opinion.

    Every text is taken apart once; what is counted over words is counted for the whole batch at a time.
    """

    def __init__(self, models: Models):
        self.m, self.words = models, Words(models.word_languages)
        self.fixed: dict[str, list[int]] = {}

    def vote(self, records: list[Record]) -> list[dict[str, list[int]]]:
        return self.vote_planted(records, None)[0]

    def vote_planted(self, records: list[Record], draws: np.ndarray | None) -> tuple[list[dict[str, list[int]]], list[Planted]]:
        """Votes; and where there are numbers to draw by, what planted() would make of each record and how its functions
        vote, without taking the texts apart again. Only the functions of the planted defect matter."""
        out: list[dict[str, list[int]] | None] = []
        plants = [dict.fromkeys(PLANTS) for _ in records]
        inner, found = [], []
        for _, answer, _, _ in records:
            text = TAGS.sub(" ", answer) if "<" in answer else answer
            said = words(text)
            empty = not said or (len(said) <= 4 and " ".join(said) in PLACEHOLDERS)
            out.append(self.nothing(answer, said) if empty else None)
            inner.append(text)
            found.append(said)
        left = [i for i, v in enumerate(out) if v is None or (draws is not None and found[i])]  # placeholders have questions, too
        if left:
            parts = [records[i] for i in left], [inner[i] for i in left], [found[i] for i in left]
            for i, v, x in zip(left, *self.content(*parts, None if draws is None else draws[left])):
                out[i], plants[i] = out[i] or v, x
        if draws is not None and records:
            if not self.fixed:
                bare_voter = lambda a, d: code(self.vote([("", a, "", [])])[0][d])
                self.fixed = {"empty": [bare_voter(a, "empty") for a in EMPTIED], "refusal": [bare_voter(a, "refusal") for a in DECLINED]}
            for said, x, draw in zip(found, plants, draws.tolist()):
                for d, patterns in self.fixed.items() if said else ():
                    x[d] = patterns[draw % len(patterns)]
        self.words.fresh()
        return out, plants

    @staticmethod
    def nothing(answer: str, said: list[str]) -> dict[str, list[int]]:
        """An answer without content says nothing about the other defects."""
        visible = sum(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc") for c in answer)
        empty = [0 if said else 1, 1 if said else 0, 1 if not said and TAGS.search(answer) else 0, 0 if visible else 1]
        return {d: empty if d == "empty" else [0] * len(r) for d, r in RULES.items()}

    def content(self, records: list[Record], inner: list[str], found: list[list[str]], draws: np.ndarray | None = None) -> tuple[list[dict[str, list[int]]], list[Planted]]:
        n = len(records)
        stems, rests, own, own_words, asked = [], [], [], [], []
        for (question, answer, _, _), text, said in zip(records, inner, found):
            parts = CHOICES.split(question, maxsplit=1) if "\n" in question else [question]
            stems.append(parts[0])
            rests.append(question[len(parts[0]) :])
            bare_text = QUOTED.sub(" ", answer) if not QUOTES.isdisjoint(answer) else answer
            mine = bare_text if bare_text is answer or WORD.search(bare_text) else answer
            own.append(mine)
            own_words.append(said if mine is answer and text is answer else words(mine))
            asked.append(self.asked(text, said))
        marked = [t.translate(MARKED).replace(".", " . ").split() if t.isascii() else [w.lower() for w in SENTENCE_WORDS.findall(t)] for t in stems]
        flat, owner = self.words.of(marked)
        ends = np.isin(flat, [self.words[x] for x in SENTENCE_ENDS if x in self.words])
        sentence = np.cumsum(np.r_[0, (ends[:-1] | (owner[1:] != owner[:-1])).astype(np.int64)]) if len(flat) else np.zeros(0, np.int64)
        stem, sentence = (flat[~ends], owner[~ends]), sentence[~ends]
        rest = self.words.of([words(t) if t else [] for t in rests])
        order = np.argsort(np.r_[stem[1], rest[1]], kind="stable")
        question = np.r_[stem[0], rest[0]][order], np.r_[stem[1], rest[1]][order]
        answer = self.words.of(asked)
        copies = Copies(n, answer, question, stem, sentence, 4)
        mine = self.words.of(own_words)
        thought = self.words.of([words(t) for _, _, t, _ in records])
        w = self.words
        script_q, script_a, script_t = [script(t) for t in stems], [script(t) for t in own], [script(t) for _, _, t, _ in records]
        lang_q, n_q = languages(script_q, *stem, w.spoken)
        lang_a, n_a = languages(script_a, *mine, w.spoken)
        lang_t, n_t = languages(script_t, *thought, w.spoken)
        sides_q = list(map(self.question_side, script_q, zip(lang_q.tolist(), n_q.tolist()), zip(lang_t.tolist(), n_t.tolist())))
        own_of = w.own[mine[0]]
        belong = np.flatnonzero(own_of)
        said = np.bincount(mine[1][belong] * len(LANGUAGES) + own_of[belong] - 1, minlength=n * len(LANGUAGES)).reshape(n, len(LANGUAGES))
        n_w = said.max(1, initial=0)
        held = (said * 2 >= n_w[:, None]) @ (1 << np.arange(len(LANGUAGES)))
        sides_a = list(map(self.answer_side, script_a, zip(lang_a.tolist(), n_a.tolist()), zip(n_w.tolist(), held.tolist()), map(len, own_words)))
        again = self.copied(records, stems, script_q, marked, question, stem, sentence) if draws is not None else [None] * n
        roles = w.roles[mine[0]]
        bearing = np.flatnonzero(roles)
        who, what = mine[1][bearing], roles[bearing]
        role = list(zip(*((np.bincount(who, what >> i & 1, n) > 0).tolist() for i in range(len(ROLE_SETS)))))
        out, plants = [], []
        for i, (q, a, _, choices) in enumerate(records):
            whole, prefix, core = self.choice(a, choices)
            v = {"empty": [-1, 0 if len(found[i]) < 2 else -1, 0 if "<" in a else -1, -1 if len(inner[i]) >= 4 else 0]}
            v["refusal"] = self.refusal(own[i], own_words[i], script_a[i], *role[i])
            asks = "?" in a or "？" in a
            if script_q[i] in OWN and script_a[i] == script_q[i]:
                v["copied_question"] = self.letters(stems[i], asked[i], asks)
            elif len(asked[i]) < 5 or whole or prefix:
                v["copied_question"] = [-1, -1, -1, 0]
            else:
                v["copied_question"] = copies.votes(i, asks)
            of_question, of_answer = sides_q[i], sides_a[i]
            v["other_language"] = self.language(of_question, of_answer)
            v["truncated"] = self.ending(a, core, whole, prefix)
            out.append(v)
            x = dict.fromkeys(PLANTS)
            if draws is not None:
                x |= {"copied_question": again[i], "truncated": self.shortened(a, choices, int(draws[i]))}
                x["asked"] = shown(of_question) if of_question[1] >= 0 else None
                x["told"] = shown(of_answer) if of_answer[1] >= 0 and of_answer[2] else None
            plants.append(x)
        return out, plants

    @staticmethod
    def asked(text: str, said: list[str]) -> list[str]:
        """Words of an answer, without an announcement that the question is repeated."""
        start = ASKING.match(text)
        return words(text[start.end() :]) if start else said

    def copied(self, records: list[Record], stems: list[str], scripts: list[str | None], marked: list[list[str]], question, stem, sentence: np.ndarray) -> list[int | None]:
        """How the functions vote on each question as its own answer; None where that is too short to be planted.

        All words and runs of such an answer come from the question, and so do those of each sentence; only answers that lose
        tags or an announcement are compared with it.
        """
        answers = [t.strip() for t in stems]
        inner = [TAGS.sub(" ", t) if "<" in t else t for t in answers]
        less = {i: self.asked(t, words(t)) for i, t in enumerate(inner) if t is not answers[i] or ASKING.match(t)}
        sizes = np.bincount(stem[1], minlength=len(records))
        whole = np.zeros(len(records), bool)
        whole[stem[1][np.bincount(sentence)[sentence] >= 4]] = True
        sizes, whole = sizes.tolist(), whole.tolist()
        if less:
            at = np.full(len(records), -1)
            at[list(less)] = np.arange(len(less))
            part = lambda x: (x[0][at[x[1]] >= 0], at[x[1]][at[x[1]] >= 0])
            copies = Copies(len(less), self.words.of(list(less.values())), part(question), part(stem), sentence[at[stem[1]] >= 0], 4)
        out = []
        for i, (q, _, _, choices) in enumerate(records):
            a = answers[i]
            size = len(words(inner[i])) if i in less else sizes[i]
            if size < 5:
                if len(words(q)) < 5:
                    out.append(None)
                    continue
                if not size or " ".join(words(inner[i])) in PLACEHOLDERS:
                    out.append(code([0, 0, 0, 0]))
                    continue
            asks = "?" in a or "？" in a
            bare_text = QUOTED.sub(" ", a) if scripts[i] in OWN and not QUOTES.isdisjoint(a) else a
            if scripts[i] in OWN and (bare_text is a or script(bare_text if WORD.search(bare_text) else a) == scripts[i]):
                asked = less[i] if i in less else [x for x in marked[i] if x not in SENTENCE_ENDS]
                out.append(code(self.letters(stems[i], asked, asks)))
            elif (len(less[i]) if i in less else size) < 5 or any(self.choice(a, choices)[:2]):
                out.append(code([-1, -1, -1, 0]))
            elif i in less:
                out.append(code(copies.votes(int(at[i]), asks)))
            else:
                out.append(code([1, 1, 1 if whole[i] else -1, int(asks)]))
        return out

    def shortened(self, answer: str, choices: list[tuple[str, str]], draw: int) -> int | None:
        """How the functions vote on the answer cut short; None where it isn't planted."""
        a = cut_short(answer, draw)
        if a is None:
            return None
        said = words(TAGS.sub(" ", a) if "<" in a else a)
        if not said or (len(said) <= 4 and " ".join(said) in PLACEHOLDERS):
            return code([0, 0, 0, 0])
        whole, prefix, core = self.choice(a, choices)
        return code(self.ending(a, core, whole, prefix))

    @staticmethod
    def choice(answer: str, choices: list[tuple[str, str]]) -> tuple[bool, bool, str]:
        """Whether the answer is one of the choices, or the beginning of one; and the answer without marks at its end."""
        core = bare(strip_end(answer)).rstrip("-‐–… ")
        whole = prefix = False
        if core:
            for k, v in choices:
                if len(core) > len(k) + 2 + len(v):
                    continue
                for full in (f"{k}. {v}", f"{k}) {v}", f"{k}: {v}", v):
                    if full.startswith(core):
                        f = bare(full)
                        if f == core:
                            whole = True
                        elif len(core) >= 4 and f.startswith(core):
                            prefix = True
        return whole, prefix, core

    @staticmethod
    def refusal(own: str, said: list[str], script_a: str | None, may_decline: bool, may_once: bool, may_offer: bool, may_speak: bool, first: bool) -> list[int]:
        low = own.replace("’", "'")
        ways = REFUSALS if may_decline or script_a != "latin" else REFUSALS_ONCE if may_once else None
        declines = ways is not None and ways.search(low) is not None
        sorry = APOLOGY.match(low) is not None
        offer = may_offer and OFFER.search(low) is not None
        third = (may_speak or said[0] in PERSONS or "apologi" in low) and "i" not in said and THIRD.match(low) is not None
        return [1 if declines else -1, 1 if sorry else 0, 1 if offer else 0, -1 if third else 0, 0 if declines or sorry or first else -1]

    @staticmethod
    def letters(stem: str, asked: list[str], asks: bool) -> list[int]:
        """As Copies, of writing without spaces: letters instead of words, runs of six."""
        a = "".join(asked)
        if len(a) < 8:
            return [-1, -1, -1, 0]
        code = lambda t: (np.array([ord(c) for c in t], np.int64), np.zeros(len(t), np.int64))
        sentences = ["".join(words(s)) for s in re.split(r"(?<=[.!?。？！])", stem)]
        q = code("".join(sentences))
        return Copies(1, code(a), q, q, np.repeat(np.arange(len(sentences)), [len(s) for s in sentences]), 6).votes(0, asks)

    @staticmethod
    def question_side(script_q, asked, thought) -> QuestionSide:
        """What the votes on the language need of question and thinking: script, language if known, that of the thinking."""
        (lang_q, n_q), (lang_t, n_t) = asked, thought
        return script_q, lang_q if n_q >= 2 else -1, lang_t if n_t >= 3 else -1

    @staticmethod
    def answer_side(script_a, told, said, length: int) -> AnswerSide:
        """What they need of an answer: script, language, whether several function words tell it, whether it is short; how
        many words belong to one language, up to two; the languages that have half of these or more; whether they are many."""
        (lang_a, n_a), (n_w, held) = told, said
        return script_a, lang_a, n_a >= 2, length <= 8, min(n_w, 2), held, n_w * 2 > length or n_w >= 3

    @staticmethod
    def language(of_question: QuestionSide, of_answer: AnswerSide) -> list[int]:
        (script_q, known, thinks), (script_a, lang_a, sure, short, n_w, held, many) = of_question, of_answer
        other = [0, 0, 0, 0]
        if known >= 0:
            if lang_a >= 0:
                other[0] = -1 if lang_a == known else 1 if sure or short else 0
            if script_a and script_q:
                other[1] = 1 if script_a != script_q and {script_a, script_q} != {"han", "kana"} else -1 if script_q != "latin" else 0
            if n_w >= 2:
                other[2] = -1 if known < len(LANGUAGES) and held >> known & 1 else 1 if many else 0
            if thinks >= 0 and lang_a >= 0 and (sure or lang_a >= len(LANGUAGES)):
                other[3] = -1 if lang_a == thinks else 1 if thinks == known else 0
        if lang_a < 0 and n_w == 0 and other[1] <= 0:
            other = [-1 if x == 0 else x for x in other]
        return other

    def ending(self, answer: str, core: str, whole: bool, prefix: bool) -> list[int]:
        ends = finished(answer) and not strip_end(answer).endswith("…")
        score = -12.0 if ends and not self.m.ends.may_be_open(answer) else self.m.ends.judge(answer)
        last, more = last_token(core)
        seen, longer = self.m.ends.known(last.lower()) if last else (3, 0)
        hyphen = strip_end(answer).endswith(("-", "‐"))
        return [
            1 if score >= 0.5 else -1 if score <= -1.5 else 0,
            -1 if whole else 1 if prefix else 0,
            -1 if ends else 1 if hyphen or (seen == 0 and longer >= 1 and last and last[0].islower()) else 0,
            -1 if ends else 1 if last and last.lower() in DANGLING and more else 0,
        ]


def code(votes: list[int]) -> int:
    n = 0
    for v in votes:
        n = n * 3 + v + 1
    return n


def decode(n: int, length: int) -> list[int]:
    out = []
    for _ in range(length):
        out.append(n % 3 - 1)
        n //= 3
    return out[::-1]


def _models(qa: DataFrame, sample: int) -> Models:
    return train(sample_texts(qa, "qa_id", ["answer", "question"], sample), qa.select("answer").unionAll(qa.select("question")))


def defect_votes(qa: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """qa_id and one vote pattern per defect, one row per record: of repeated deliveries the last counts."""
    return _voted(qa, _models(qa, sample)).select("qa_id", *RULES)


def _record(question, answer, thinking, choices) -> Record:
    return question or "", answer or "", thinking or "", [(str(k), str(v)) for k, v in (choices.items() if isinstance(choices, dict) else choices or []) if v is not None]


def planted(records: list[Record], seed: int = 3) -> dict[str, list[Record]]:
    """Records with one defect each: an answer emptied, declined, replaced by the question, by an answer of another record
    in another language, or cut within a word or a sentence."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    tongues = [language(a) for _, a, _, _ in records]
    foreign = {k: [a for (_, a, _, _), (other, n) in zip(records, tongues) if other and other != k and n >= 2] for k in {language(q)[0] for q, _, _, _ in records}}
    out: dict[str, list[Record]] = {d: [] for d in RULES}
    for q, a, t, c in records:
        if not words(a):
            continue
        out["empty"].append((q, pick(EMPTIED), t, c))
        out["refusal"].append((q, pick(DECLINED), t, c))
        if len(words(q)) >= 5:
            out["copied_question"].append((q, CHOICES.split(q, maxsplit=1)[0].strip(), t, c))
        if (asked := language(q))[1] >= 2 and foreign[asked[0]]:
            out["other_language"].append((q, pick(foreign[asked[0]]), t, c))
        if (short := cut_short(a, int(rng.integers(1 << 60)))) is not None:
            out["truncated"].append((q, short, t, c))
    return out


def cut_short(answer: str, draw: int) -> str | None:
    """A finished answer of eight words or more, cut somewhere in its last two thirds."""
    if not finished(answer) or len(words(answer)) < 8:
        return None
    core = bare(strip_end(answer))
    first, last = len(core) // 3, len(core) - 3
    return core[: first + draw % (last - first)].rstrip() if last > first else None


def validated_cutoffs(qa: DataFrame, models: Models, posterior: dict[tuple[str, int], float], voted: DataFrame | None = None) -> dict[str, float]:
    """By defect the cutoff, of those tried, that finds the largest share of planted defects less the share of the records,
    as delivered, that it marks; ties go to the one nearest to 0.5.

    Every defect is planted in every record that can hold it. An answer in another language is each such answer of all
    records in turn, by the counts of what the functions see of questions and of answers. A pattern no record shows has
    posterior 0. Only counts of patterns come to the driver. voted: the result of _voted, if it is at hand.
    """
    voted = _voted(qa, models) if voted is None else voted
    values = [*RULES, *(f"planted_{d}" for d in PLANTS)]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("string").alias("value")) for v in values])).alias("x")
    seen: dict[str, dict[str, int]] = {v: {} for v in values}
    for r in voted.select(each).filter("x.value is not null").groupBy("x.name", "x.value").count().collect():
        seen[r.name][r.value] = r["count"]
    if not seen["empty"]:
        return dict(CUTOFFS)
    cutoffs = {}
    for d in RULES:
        marked = {int(v): float(n) for v, n in seen[d].items()}
        if d == "other_language":
            found, planted_in = _foreign(seen["planted_asked"], seen["planted_told"])
        else:
            found = {int(v): float(n) for v, n in seen[f"planted_{d}"].items()}
            planted_in = sum(found.values())
        share = lambda counts, c: sum(n for p, n in counts.items() if posterior.get((d, p), 0.0) >= c) / max(sum(counts.values()), 1e-9)  # noqa: B023, E731
        gain = [share(found, c) - share(marked, c) if planted_in >= LEAST else 0.0 for c in TRIED]
        cutoffs[d] = TRIED[int(np.argmax(np.round(gain, 3)))]
    return cutoffs


def _foreign(asked: dict[str, int], told: dict[str, int]) -> tuple[dict[int, float], int]:
    """By pattern how many records show it whose answer is one in another language, each of these being as likely; and how
    many records there are that can have one."""
    answers = [(ast.literal_eval(v), n) for v, n in told.items()]
    found: Counter[int] = Counter()
    count = 0
    for v, n in asked.items():
        question = ast.literal_eval(v)
        others = [(a, m) for a, m in answers if a[1] != question[1]]
        total = sum(m for _, m in others)
        count += n if total else 0
        for a, m in others:
            found[code(Voter.language(question, a))] += n * m / total
    return dict(found), count


def _voted(qa: DataFrame, models: Models) -> DataFrame:
    shared = qa.sparkSession.sparkContext.broadcast(models)
    names = ["qa_id", "loaded_at", *RULES, *(f"planted_{d}" for d in PLANTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(shared.value)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                draws = mix64(b.column(0).fill_null(0).to_numpy().view(np.uint64) + np.uint64(8)) >> np.uint64(4)
                rows, plants = voter.vote_planted([_record(*r) for r in zip(*(b.column(i).to_pylist() for i in range(2, 6)))], draws)
                patterns = [pa.array([code(r[d]) for r in rows], pa.int32()) for d in RULES]
                made = [pa.array([x[d] for x in plants], pa.int32() if kind == "int" else pa.string()) for d, kind in PLANTS.items()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *patterns, *made], names)

    schema = "qa_id bigint, loaded_at timestamp, " + ", ".join([*(f"{d} int" for d in RULES), *(f"planted_{d} {kind}" for d, kind in PLANTS.items())])
    voted = qa.select("qa_id", "loaded_at", "question", "answer", "thinking", F.map_filter("choices", lambda k, v: v.isNotNull()).alias("choices"))
    voted = spread(voted, "qa_id", "loaded_at").mapInArrow(run, schema)
    return cut(first_per_key(voted, ["qa_id"], names[2:], "loaded_at"))


def defect_labels(qa: DataFrame, sample: int = SAMPLE, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(qa_id, defect, posterior): every defect of a record whose posterior reaches its cutoff, several if several do.

    One label model per defect, fitted on the counts of its vote patterns over all records (at most 3 ** 5 patterns).
    Cutoffs that aren't given are validated on planted defects. A null answer, question or thinking counts as an empty
    text; choices may be null. Sampling bounds only what the weights of the ending model are fitted on; words are counted
    and cutoffs validated over all records, and all are judged.
    """
    models = _models(qa, sample)
    voted = _voted(qa, models)
    long = voted.select("qa_id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in RULES])).alias("x")).select("qa_id", "x.*")
    seen: dict[str, list[tuple[int, int]]] = {d: [] for d in RULES}
    for r in long.groupBy("defect", "pattern").count().collect():
        seen[r.defect].append((r.pattern, r["count"]))
    table = []
    for d, patterns in seen.items():
        if patterns:
            votes = np.array([decode(p, len(RULES[d])) for p, _ in patterns])
            post, _ = fit_labels(votes, np.array([c for _, c in patterns]), 0.03)
            table += [(d, p, float(x)) for (p, _), x in zip(patterns, post)]
    cutoffs = cutoffs or validated_cutoffs(qa, models, {(d, p): x for d, p, x in table}, voted)
    kept = [x for x in table if x[2] >= cutoffs[x[0]]]
    weights = qa.sparkSession.createDataFrame(kept, "defect string, pattern int, posterior double")
    return long.join(F.broadcast(weights), ["defect", "pattern"]).select("qa_id", "defect", "posterior")


def one_defect(labels: DataFrame) -> DataFrame:
    """(qa_id, defect): of several labels the first in the order of CUTOFFS."""
    rank = F.create_map(*[F.lit(x) for i, d in enumerate(CUTOFFS) for x in (d, i)])
    return labels.groupBy("qa_id").agg(F.min_by("defect", rank[F.col("defect")]).alias("defect"))
