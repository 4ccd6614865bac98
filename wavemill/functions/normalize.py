"""Normalisers of transcripts. Those that need Unicode decomposition or number grammar run as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Letters that decomposition leaves as they are.
DIACRITICS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}
# Fixed values, applied in this order.
REPLACERS = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "),
    (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
]
# What each step takes out or puts in, in this order.
BRACKETED = [(r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", "")]
HESITATIONS = [(r"\b(hmm|mm|mhm|mmm|uh|um)\b", ""), (r"\s+'", "'")]
NUMBER_MARKS = [(r"(\d),(\d)", r"\1\2"), (r"\.([^0-9]|$)", r" \1")]
LONELY_MARKS = [(r"[.$¢€£]([^0-9])", r" \1"), (r"([^0-9])%", r"\1 ")]
SPACES = [(r"\s+", " ")]
WORDS_ONLY = [(T.BRACKET_SPAN, ""), (r"[^\w\s]", "")]
SPACED = [(p, r"\1 ") for p in T.CJK_SPACES]
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
ORDINALS = {"first": ("1", "st"), "second": ("2", "nd"), "third": ("3", "rd"), "fifth": ("5", "th"), "eighth": ("8", "th"), "ninth": ("9", "th"), "twelfth": ("12", "th")}
CURRENCY = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢"}
VALUE = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | {"oh": 0, "o": 0}


class Rules:
    """An ordered table of patterns and what they are replaced by, as one step."""

    def __init__(self, *tables: list[tuple[str, str]]):
        self.steps = [(re.compile(p), by) for t in tables for p, by in t]

    def __call__(self, s: str) -> str:
        for pattern, by in self.steps:
            s = pattern.sub(by, s)
        return s


class Fold(dict):
    """Normalises to a form, then translates letter by letter: by general category, with exceptions. The table of
    translations fills as letters are met."""

    def __init__(self, form: str, of_category: dict[str, str], exceptions: dict[str, str]):
        super().__init__({ord(k): v for k, v in exceptions.items()})
        self.form, self.of_category = form, of_category

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = self.of_category.get(kind, self.of_category.get(kind[0], chr(code)))
        return self[code]

    def __call__(self, s: str) -> str:
        return unicodedata.normalize(self.form, s).translate(self)


BLANKED = {"M": " ", "S": " ", "P": " "}
#: Compatibility decomposition, non-spacing marks dropped, listed letters spelled out, symbols and punctuation as spaces.
fold_symbols = Fold("NFKD", BLANKED | {"Mn": ""}, DIACRITICS)
#: As fold_symbols, with the marks that numbers need.
fold_all_but_number_marks = Fold("NFKD", BLANKED | {"Mn": ""}, DIACRITICS | {x: x for x in ".%$¢€£"})
#: Compatibility composition; marks, symbols and punctuation as spaces, diacritics kept.
fold_symbols_only = Fold("NFKC", BLANKED, {})
no_brackets, one_space = Rules(BRACKETED), Rules(SPACES)
spoken = Rules(BRACKETED, HESITATIONS, REPLACERS, NUMBER_MARKS)
no_lonely_marks, words_only, spaced_cjk = Rules(LONELY_MARKS), Rules(WORDS_ONLY), Rules(SPACED)


def through(s: str, *steps: Callable[[str], str]) -> str:
    for step in steps:
        s = step(s)
    return s


def graphemes(s: str) -> str:
    """A space between letters, their marks kept with them."""
    return " ".join(re.findall(r"\w[̀-ͯ]*|\S", s))


def basic(s: str, remove_diacritics: bool = False, split_letters: bool = False) -> str:
    """Lower-cased, bracketed words removed, symbols folded, spaces merged, optionally a space after every grapheme."""
    folded = fold_symbols if remove_diacritics else fold_symbols_only
    return through(s, str.lower, no_brackets, folded, str.lower, *([graphemes] if split_letters else []), one_space)


def _ordinal(word: str) -> tuple[int, str] | None:
    if word in ORDINALS:
        return int(ORDINALS[word][0]), ORDINALS[word][1]
    for end, start in (("ieth", "y"), ("th", "")):
        if word.endswith(end) and (v := VALUE.get(word[: -len(end)] + start)):
            return v, "th"
        if word.endswith("th") and (v := SCALES.get(word[:-2])):
            return v, "th"
    return None


def spelled_numbers(s: str) -> str:
    """Spelled numbers as digits: 'two hundred and five' 205, 'twenty first' 21st, 'three point one' 3.1, 'five dollars' $5,
    'ten percent' 10%, 'nineteen ninety' 1990, 'minus two' -2. Digits in the text join in: '3 million' 3000000."""
    words, out, i = re.sub(r"([$£€¢]?)\b(\d+(?:\.\d+)?)(st|nd|rd|th)?\b", r" \1\2\3 ", s).split(), [], 0

    def number(at: int) -> tuple[str, int] | None:
        """Digits of the number from word at, and the place after it."""
        total = group = 0
        last, j, any_seen, digits = None, at, False, ""
        while j < len(words):
            w = words[j]
            if w in VALUE and (w not in ("o", "oh") or any_seen):
                v = VALUE[w]
                if last is None:
                    group = v
                elif last == "scale":
                    group += v
                elif last == "ten" and 0 < v < 10:
                    group += v
                else:  # a sequence such as a year or a spelled-out code
                    digits, total, group = digits + str(total + group), 0, v
                last = "ten" if v >= 20 else "one"
            elif w in SCALES and (any_seen or w != "o"):
                if not any_seen:
                    return None
                if SCALES[w] == 100:
                    group = (group or 1) * 100
                else:
                    total, group = total + (group or 1) * SCALES[w], 0
                last = "scale"
            elif re.fullmatch(r"\d+(?:\.\d+)?", w):
                if any_seen and last != "scale":
                    break
                if "." in w:
                    scale = SCALES.get(words[j + 1]) if j + 1 < len(words) else None
                    if any_seen:
                        break
                    if not scale:
                        return w, j + 1
                    v = round(float(w) * scale)
                    return str(v), j + 2
                group, last = group + int(w), "one"
            elif w == "and" and last == "scale" and j + 1 < len(words) and (words[j + 1] in VALUE or words[j + 1] == "a"):
                j += 1
                continue
            else:
                break
            any_seen, j = True, j + 1
        if not any_seen:
            return None
        value = digits + str(total + group)
        if j + 1 < len(words) and words[j] == "point" and words[j + 1] in VALUE:
            j, value = j + 1, value + "."
            while j < len(words) and words[j] in VALUE and VALUE[words[j]] < 10:
                value, j = value + str(VALUE[words[j]]), j + 1
        return value, j

    while i < len(words):
        w = words[i]
        sign = "-" if w in ("minus", "negative") else "+" if w in ("plus", "positive") else ""
        if m := re.fullmatch(r"([$£€¢])(\d+(?:\.\d+)?)", w):
            sign, words[i] = m[1], m[2]
            found = number(i)
        else:
            found = number(i + 1) if sign else number(i)
        if found:
            value, j = found
            o = _ordinal(words[j]) if j < len(words) else None
            if o and re.fullmatch(r"\d+", value) and (int(value) % 100 >= 20 and o[0] < 10 or o[0] >= 100):
                n = int(value) + o[0] if o[0] < 10 else int(value) * o[0]
                out.append(f"{n}{o[1]}")
                i = j + 1
                continue
            mark = CURRENCY.get(words[j]) if j < len(words) else None
            if mark:
                value, j = mark + value, j + 1
            elif words[j : j + 1] == ["percent"]:
                value, j = value + "%", j + 1
            elif words[j : j + 2] == ["per", "cent"]:
                value, j = value + "%", j + 2
            out.append(sign + value)
            i = j
            continue
        if (o := _ordinal(w)) is not None:
            out.append(f"{o[0]}{o[1]}")
        else:
            out.append(w)
        i += 1
    return " ".join(out)


def english(s: str, spelling: dict[str, str] | None = None, latin_only: bool = True) -> str:
    """Lower-cased; brackets, hesitations and symbols removed; contractions and titles spelled out; numbers as digits;
    words respelled by the given map. latin_only=False keeps letters of other scripts and their marks (code switching)."""
    known = spelling or {}
    respelled = lambda t: " ".join(known.get(w, w) for w in t.split())
    folded = [fold_all_but_number_marks] if latin_only else []
    return through(s, str.lower, spoken, *folded, spelled_numbers, respelled, no_lonely_marks, one_space, str.strip)


to_word_form = Rules([(rf"\b{k}\b", v) for k, v in [*T.DIGIT_WORDS.items(), *T.CONTRACTIONS.items()]])
no_fillers = Rules([(T.FILLERS, "")])


def _finish(s: str) -> str:
    return " ".join(through(s, to_word_form, words_only, no_fillers).split())


def asr(s: str) -> str:
    """English transcripts: the English normaliser, numbers and contractions as words, brackets, punctuation, fillers out."""
    return _finish(english(s.lower()))


def asr_chinese(s: str) -> str:
    """Transcripts that switch between English and Chinese: as asr, ideographs spaced out."""
    return spaced_cjk(asr(s))


def asr_three_languages(s: str) -> str:
    """As asr_chinese, other scripts kept."""
    return spaced_cjk(_finish(english(s.lower(), latin_only=False)))


def thai(s: str, dictionary: frozenset[str] = frozenset()) -> str:
    """Raw text in words by greedy longest match against a dictionary, single characters where none fits."""
    out: list[str] = []
    longest = max(map(len, dictionary), default=1)
    for part in s.split():
        i = 0
        while i < len(part):
            n = next((m for m in range(min(longest, len(part) - i), 0, -1) if part[i : i + m] in dictionary), 1)
            out.append(part[i : i + n])
            i += n
    return " ".join(out)


def udf(f: Callable[[str], str]):
    """An Arrow-batched column function of a text function; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x), na_action="ignore")

    return run


def vietnamese(x: Column) -> Column:
    return T.letters_only(x)


#: Text preparation by family of benchmark.
FAMILIES: dict[str, Callable[[str], str]] = {"asr": asr, "asr_zh": asr_chinese, "asr_mixed": asr_three_languages, "thai": thai, "basic": basic, "english": english}
