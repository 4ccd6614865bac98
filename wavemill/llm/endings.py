"""A small model, trained here, of whether the last sentence of a text is complete.

It teaches itself: sentences that the corpus finishes with a mark or a line end are complete once the mark is taken
off, and the same sentences cut at a random place are not.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from . import lexicon

SIZE = 1 << 18
#: Bound of the sample the model is fitted on: so many texts, those with the smallest hashes.
SAMPLE = 20_000
#: Bound of the sentences taken from it, and so many most frequent words stand for themselves in the shape of a sentence.
SENTENCES, HEADS = 120_000, 120
#: Longer texts aren't sampled, so that the sample has a bound in bytes; they are judged as all others.
LONGEST = 20_000

CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
TOKEN = re.compile(rf"[{CJK}]|[^\W_{CJK}]+(?:['’-][^\W_{CJK}]+)*|[,;:—–-]")
BREAK = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])|\n+")
MARKS, CLOSERS = set(".!?。！？…‥।؟"), set("\"'”’»)]}>』」）】*_`~")
OPEN, SHUT = "([{（【「『", ")]}）】」』"
OPENING = re.compile(r"[(\[{（【「『<]")
#: ASCII characters as they stand in tokens, all others as spaces: as they are, and lower-cased.
HELD = {i: chr(i) if chr(i).isalnum() or chr(i) in ",;:-'" else " " for i in range(128)}
LOWERED = {i: c.lower() for i, c in HELD.items()}


def tokens_of(text: str, lower: bool = False) -> list[str]:
    """TOKEN.findall, lower-cased or not."""
    if not text.isascii():
        found = TOKEN.findall(text)
        return [x.lower() for x in found] if lower else found
    for c in ",;:":
        if c in text:
            text = text.replace(c, f" {c} ")
    found = text.translate(LOWERED if lower else HELD).split()
    if "'" in text or "-" in text:  # within a word or between words
        return [x for t in found for x in ((t,) if t.isalnum() else TOKEN.findall(t))]
    return found


def strip_end(text: str) -> str:
    """Without white space, format characters and emoji at the end, which say nothing about completeness."""
    i = len(text)
    if i and "!" <= text[-1] <= "~":
        return text
    while i and (text[i - 1].isspace() or ord(text[i - 1]) >= 0x1F000 or text[i - 1] in "​‍⁠️﻿☀♪♫❤"):
        i -= 1
    return text[:i]


def finished(text: str) -> bool:
    """Ends with a final mark, before closing quotes and brackets or not."""
    t = strip_end(text)
    i = len(t)
    while i and t[i - 1] in CLOSERS:
        i -= 1
    return i > 0 and (t[i - 1] in MARKS)


def last_token(text: str) -> tuple[str, bool]:
    """The last token, and whether there is another before it."""
    at = max(text.rfind(" "), text.rfind("\n")) + 1
    found = TOKEN.findall(text, at) or TOKEN.findall(text)
    return (found[-1], len(found) > 1 or TOKEN.search(text, 0, at) is not None) if found else ("", False)


def open_at_end(text: str) -> bool:
    """An unclosed bracket on the last line, an unclosed tag, or unclosed braces of an object."""
    if not OPENING.search(text):
        return False
    t = text.rstrip()
    line = t.rsplit("\n", 1)[-1]
    depth: list[str] = []
    for c in line:
        if c in OPEN:
            depth.append(SHUT[OPEN.index(c)])
        elif depth and c == depth[-1]:
            depth.pop()
    if depth:
        return True
    for tag in ("answer", "think", "semantic_elements"):
        if len(re.findall(rf"(?:^|[\n>])\s*<{tag}>", t)) > t.count(f"</{tag}>"):  # one within a line is a stray string
            return True
    if re.search(r"<[/a-z_]{0,20}$", t):
        return True
    return t.lstrip().startswith("{") and t.count("{") > t.count("}")


def last_sentence(text: str) -> str:
    t = strip_end(text)
    return BREAK.split(t)[-1]


def sentences(text: str) -> tuple[list[str], str]:
    """Sentences that something follows, and the last one."""
    parts = [p for p in BREAK.split(strip_end(text)) if p and p.strip()]
    return parts[:-1], parts[-1] if parts else ""


def whole_words(text: str) -> list[str]:
    """Tokens of a text, without the last one if no final mark follows it: that may be a piece of a word."""
    tokens = tokens_of(text, True)
    return tokens if finished(text) else tokens[:-1]


def bare(sentence: str) -> str:
    """Without final marks and closers."""
    i = len(sentence)
    while i and (sentence[i - 1] in MARKS or sentence[i - 1] in CLOSERS or sentence[i - 1].isspace()):
        i -= 1
    return sentence[:i]


# Articles, prepositions and conjunctions of several languages, which seldom end a sentence.
DANGLING = frozenset(
    "a an the and or but of to with by from as which while until than because if into nor plus un una el la los las de del y que con en le les des du et au ein eine einen einem der die das den dem und mit im os um uma do da e com em и в на с по".split()
)
DANGLING_WEIGHT = 2.0


@dataclass
class EndModel:
    weights: np.ndarray
    words: lexicon.Memory | lexicon.Table
    heads: frozenset[str]

    def known(self, word: str) -> tuple[int, int]:
        """Buckets of how often the word was seen, and the most frequent longer word that begins with it."""
        return divmod(self.words.get(word), 4)

    @staticmethod
    def may_be_open(text: str) -> bool:
        """Holds an opening bracket or tag, which may be unclosed."""
        return OPENING.search(text) is not None

    def features(self, sentence: str, whole_start: bool = True, found: list[str] | None = None) -> list[int]:
        found = tokens_of(sentence) if found is None else found
        tokens = [t.lower() for t in found]
        if not tokens:
            return [1]
        last = found[-1]
        n, lower = len(tokens), tokens[-1]
        seen, longer = self.known(lower)
        kind = "A" if last[0].isupper() else "0" if last[0].isdigit() else "a" if last[0].isalpha() else last[0]
        pad = ["^"] * 4 + tokens
        f = [f"k{seen}{longer}{kind}", f"K{seen}{longer}{kind}{min(len(lower), 6)}", f"1{lower}", f"2{pad[-2]} {lower}", f"3{pad[-3]} {pad[-2]} {lower}", f"p{pad[-2]} {seen}{longer}{kind}", f"q{pad[-3]} {pad[-2]} {seen}{longer}", f"r{pad[-4]} {pad[-3]}"]
        heads, short = self.heads, whole_start and n <= 60
        full = [t if t in heads else "*" for t in (tokens if short else tokens[-8:])]
        shape = full[-8:]
        f += [f"s{' '.join(shape[-4:])}", f"S{' '.join(shape)}", f"t{' '.join(shape[-2:])} {seen}"]
        if short:
            first, two, commas = tokens[0], " ".join(tokens[:2]), tokens.count(",")
            after = tokens[::-1].index(",") if commas else n - 1
            f += [f"f{two}|{n}", f"g{two}|{lower}", f"h{first}|{pad[-2]} {lower}", f"i{two}|{commas}|{after}", f"j{' '.join(full)}", f"l{first}|{min(n, 20)}|{seen}{longer}", f"m{' '.join(full[:2])}|{n}|{kind}"]
        crc = zlib.crc32
        try:
            return [crc(x.encode()) % SIZE for x in f]
        except UnicodeEncodeError:
            return [crc(x.encode("utf-8", "surrogatepass")) % SIZE for x in f]

    def score(self, sentence: str, whole_start: bool = True) -> float:
        """Log-odds that the sentence, from which final marks are taken, is not complete."""
        tokens = tokens_of(sentence)
        dangling = DANGLING_WEIGHT if len(tokens) > 2 and tokens[-1] in DANGLING else 0.0
        return float(self.weights[self.features(sentence, whole_start, tokens)].sum()) + dangling

    def judge(self, text: str) -> float:
        """Log-odds that the text stops before its end; the rules for marks and brackets come first."""
        t = strip_end(text)
        if not t:
            return -20.0
        if open_at_end(t):
            return 12.0
        if t.endswith(("…", "...", ". . .")):
            core, last = bare(t), (TOKEN.findall(bare(t)) or [""])[-1].lower()
            seen, longer = self.known(last) if last else (3, 0)
            return 2.0 if t[len(core) :] == "…" and seen < 2 and longer > seen else -12.0
        if finished(t):
            return -12.0
        last = last_sentence(t)
        if t[-1] in "-‐–,;" and TOKEN.search(t[:-1]):
            return max(4.0, self.score(bare(last[:-1]), len(last) < 400))
        if not TOKEN.search(last):
            return -6.0
        if t[-1] in CLOSERS:
            return -12.0
        return self.score(last, len(last) < 400)


def sample_texts(df, key: str, texts: list[str], most: int = SAMPLE) -> list[str]:
    """Different texts, of at most LONGEST code points, of about so many rows (never more), chosen by a hash of the key.

    Only the chosen rows leave their tasks; nothing is shuffled or sorted, and one scan gives all columns.
    """
    from pyspark.sql import functions as F

    space = 1 << 30
    share = min(1.0, most / max(df.count(), 1))
    chosen = F.pmod(F.xxhash64(F.lit(3), key), F.lit(space)) < int(share * space)
    short = [F.when(F.length(t) <= LONGEST, F.col(t)).alias(t) for t in texts]
    return sorted({x for r in df.filter(chosen).select(*short).collect()[:most] for x in r if x is not None})


def corpus_words(texts) -> tuple[lexicon.Table, frozenset[str]]:
    """Words of all different texts of a DataFrame, which has one column, whole, and the most frequent of them."""
    counts = lexicon.count_words(texts, lambda batch: (("", whole_words(t)) for t in batch))
    return lexicon.known_table(counts), frozenset(lexicon.most_frequent(counts, HEADS))


def fit(texts: Iterable[str], seed: int = 5, rounds: int = 6, words: tuple[lexicon.Table, frozenset[str]] | None = None) -> EndModel:
    """Trains on the given texts, at most SENTENCES sentences of them; see SAMPLE for the callers' bound.

    words: table and most frequent words of the whole corpus, if the texts are a sample of it.
    """
    rng, texts = np.random.default_rng(seed), [t for t in texts if t and t.strip()]
    closed: list[tuple[str, float]] = []
    count: Counter[str] = Counter()
    for t in texts:
        inner, end = sentences(t)
        for s in inner:
            closed.append((bare(s), 1.0))
        if finished(end):
            closed.append((bare(end), 1.0))
        elif end and not open_at_end(t):
            closed.append((end, 0.7))  # most texts are complete, whatever they end with
        if words is None:
            count.update(whole_words(t))
    table, heads = words or (lexicon.Memory(count.items()), frozenset(w for w, _ in count.most_common(HEADS)))
    model = EndModel(np.zeros(SIZE, np.float32), table, heads)
    closed = [c for c in closed if len(c[0]) >= 2]
    if len(closed) > SENTENCES:
        closed = [closed[i] for i in rng.choice(len(closed), SENTENCES, replace=False)]
    rows: list[list[int]] = []
    target: list[float] = []
    weight: list[float] = []
    for i, (s, w) in enumerate(closed):
        start = rng.random() > 0.25
        rows.append(model.features(s, start))
        target.append(0.0)
        weight.append(w)
        cut = s[: int(rng.integers(1, len(s)))].rstrip() if len(s) > 1 else s
        if cut and TOKEN.search(cut):
            rows.append(model.features(cut, start))
            target.append(1.0)
            weight.append(1.0)
    if not rows:
        return model
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r) for r in rows])
    starts = np.r_[0, np.cumsum(lengths)]
    y, v = np.array(target), np.array(weight)
    w, g2 = np.zeros(SIZE), np.full(SIZE, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 2048):
            mine = np.sort(order[at : at + 2048])
            spots = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in mine])
            f, o = flat[spots], np.repeat(np.arange(len(mine)), lengths[mine])
            z = np.bincount(o, w[f], len(mine))
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) * v[mine]
            grad = np.bincount(f, miss[o], SIZE)
            hit = np.flatnonzero(grad)
            gradient = grad[hit] + 1e-3 * w[hit]
            g2[hit] += gradient * gradient
            w[hit] -= 0.15 * gradient / np.sqrt(g2[hit])
    model.weights = w.astype(np.float32)
    return model
