from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wavemill.functions import audio as A
from wavemill.functions import keys as K
from wavemill.functions import normalize as N
from wavemill.functions import rewards as R
from wavemill.functions import scoring as S
from wavemill.functions import text as T
from wavemill.functions import vectors as V


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (T.strip, "\t a b \n", "a b"), (T.strip, None, None), (T.one_line, "a\r\nb\tc", "a b c"), (T.unbracket_first, "[[a]] (b)", "[a] (b)"), (T.unbracket, "[a] {b}", "a b"),
        (T.is_bracketed, "[é]", True), (T.is_bracketed, "[a]\n", True), (T.is_bracketed, "[a\nb]", False), (T.is_bracketed, "a]", False), (T.has_word_character, "[ !! ]", False), (T.has_word_character, "[é]", True),
        (lambda x: T.byte_length_between(x, 5, 50), "éé", False), (lambda x: T.byte_length_between(x, 4, 50), "éé", True), (T.no_pronoun, "it rings", False), (T.no_pronoun, "bit rings", True),
        (T.strict_characters, "a 'b', \"c\"", True), (T.strict_characters, "a.b", False), (T.plain_characters, "a–b!", True), (T.plain_characters, "é", False), (T.two_tokens, "a ", True), (T.two_tokens, "a", False),
        (T.word_count, "  a  b ", 2), (lambda x: T.count_token(x, "a"), "a b a", 2), (lambda x: T.replace_first(x, "a b", "c"), "a b a b", "c a b"), (T.base_name, "a/b/c.d.e", "c.d.e"), (T.stem, "a/b/c.d.e", "c.d"), (T.suffix, "a/b/c.d.e", ".e"),
        (lambda x: T.tag(x, "answer"), "p <answer> a\nb </answer> q", "a\nb"), (lambda x: T.tag(x, "answer"), " none ", "none"), (T.last_number, "Rating: 4", 4.0), (T.last_number, "Rating: four", 0.0), (T.last_number, "", 0.0), (T.has_number, "", 0),
        (T.strip_exclamations, "ok!!", "ok"), (T.starts_with_choice, "B. x", True), (T.formatted_choice_question, "q\nChoices:\nA. a\nB. b\nC. c\nD. d", True), (T.caption_of_reply, "Sure. Answer: A Dog\nmore", "a dog"), (T.caption_of_reply, "none", None),
        (T.answer_of_turn, "user\nq\nassistant\n<think>t</think><answer> b </answer>", "b"), (T.quoted_reply, "The words are 'so and so'.", "so and so"), (T.cascade_answer, "x Answer: y", "y"),
        (T.numbers_to_words, "i'm 5 of 20, it's 21", "i am five of twenty, it is 21"), (T.no_fillers, "uh so um", " so "), (T.space_cjk, "你好world", "你 好 world"), (T.letters_only, "Xin, chào!", "xin chào"), (T.or_empty_word, "", "empty"), (T.or_empty_word, None, "empty"),
        (T.csv_field, 'a "b", c', '"a ""b"", c"'), (T.csv_field, 'a "b"', 'a ""b""'), (T.no_bracket_spans, "a (b) c", "a  c"),
    ],
)
def test_text(spark, f, x, y):
    assert one(spark, x, f) == y


def test_token_lists(spark):
    assert one(spark, "Ann met Bob  twice", lambda x: T.mask_names(x, F.array(F.lit("Ann"), F.lit("Bob")))) == "person met person twice"
    assert one(spark, "a, b", lambda x: T.all_in_dictionary(x, F.array(F.lit("a"), F.lit("b")))) is True
    assert one(spark, "say [x] and (y) now", T.bracket_parts) == ["x y", "say  and  now"]
    assert sorted(one(spark, "A b, a É", T.word_set)) == ["a", "b", "é"]


@pytest.mark.parametrize("v", [1.0, 0.0, 12.5, 1e7, 12345678.25, 0.0005, 0.00001, 1.5e-7, 1e15, 1e16, 1e20, -2.0, -0.001, 123.456, 0.1, float("nan"), float("inf")])
def test_float_text_is_the_shortest_literal(spark, v):
    assert one(spark, v, K.float_text, "double") == repr(v)


def test_random_float_texts(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", K.float_text(F.col("x")).alias("t")).collect()
    assert all(float(r.t) == r.x for r in rows) and sum(r.t == repr(r.x) for r in rows) >= 270


def test_keys(spark):
    p = one(spark, "ab-_cd12345 (1_5-3_25).mp4", K.parse_clip)
    assert (p.video_id, p.start, p.end) == ("ab-_cd12345", 1.5, 3.25)
    assert one(spark, "x", K.parse_clip).video_id is None and one(spark, None, K.parse_clip).start is None
    assert one(spark, "tar/a (1.5-2.0).mp4", K.clean_member) == "a (1_5-2_0)"
    assert one(spark, 1.5, lambda x: K.clip_key(F.lit("v"), x, x + 2), "double") == "v (1_5-3_5)"
    assert one(spark, 1.0, lambda x: K.section(x, x + 0.25), "double") == "*1.000-1.250"
    d = one(spark, "vid 10-12.mp4.part", K.downloaded_name)
    assert (d.video_id, d.start, d.end) == ("vid", 10.0, 12.0)


def test_vectors(spark):
    v = "array<float>"
    assert one(spark, [3.0, 4.0], V.unit, v) == pytest.approx([0.6, 0.8]) and one(spark, [0.0, 0.0], V.unit, v) is None
    assert one(spark, [1.0, 0.0], lambda x: V.cosine(x, F.array(F.lit(0.0), F.lit(0.0))), v) is None
    assert one(spark, [1.0, 3.0, 3.0], V.argmax, v) == 1 and sum(one(spark, [1.0, 2.0, 900.0], V.softmax, v)) == pytest.approx(1)
    assert [(t.score, t.place) for t in one(spark, [2.0, 5.0, 5.0], lambda x: V.top_k(x, 2), v)] == [(5.0, 1), (5.0, 2)]
    got = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "v array<array<double>>, m array<double>").select(V.masked_mean(F.col("v"), F.col("m")).alias("y")).first().y
    assert got == pytest.approx([2.0, 3.0])


def test_rewards(spark):
    rows = [("<think>a b</think>\n<answer>cat</answer>", "cat"), ("<think>a</think><answer>dog</answer> tail", "cat"), ("cat", "cat"), ("<think>x\ny</think> <answer>catfish</answer>", "catnip")]
    d = spark.createDataFrame(rows, "c string, a string")
    got = d.select(*[f(F.col("c"), F.col("a")).alias(n) for n, f in R.REGISTRY.items()]).collect()
    assert [r.exact for r in got] == [1.0, 0.0, 1.0, 0.0] and [r.accuracy for r in got] == [0.75, 0.0, 0.75, 0.25]
    assert [r.format for r in got] == [0.5, 0.0, 0.0, 0.5] and [r.tags for r in got] == pytest.approx([0.5, 0.5 - 0.004, 0.0, 0.5])
    assert got[0].length == 1.0
    s = spark.createDataFrame([("A. cat", "the cat. a", ["A. cat", "B. dog"]), ("cat", "cat dog", ["cat", "dog"]), ("cat", "", ["cat"])], "a string, p string, c array<string>")
    assert [r.m for r in s.select(R.string_match(F.col("a"), F.col("p"), F.col("c")).alias("m")).collect()] == [True, False, False]
    w = spark.createDataFrame([(1.0, float("nan")), (None, 2.0)], "a double, b double").select(R.weighted_total([F.col("a"), F.col("b")], [1.0, 0.5]).alias("w")).collect()
    assert [r.w for r in w] == [1.0, 1.0]


@pytest.mark.parametrize(
    ("s", "t"),
    [("two hundred and five", "205"), ("twenty first", "21st"), ("three point one four", "3.14"), ("five dollars", "$5"), ("ten percent", "10%"), ("nineteen ninety", "1990"), ("minus two", "-2"), ("3 million", "3000000"), ("one two three", "123"), ("the third", "the 3rd"), ("a dog and a cat", "a dog and a cat"), ("two thousand twenty four", "2024"), ("hundred", "hundred")],
)
def test_spelled_numbers(s, t):
    assert N.spelled_numbers(s) == t


def test_normalisers():
    assert N.english("Mr. O'Neil won't pay $1,000 [laughs] (aside) hmm") == "mister o neil will not pay $1000"
    assert N.fold_symbols("Œuvre déjà-vu") == "OEuvre deja vu" and N.fold_symbols_only("déjà-vu") == "déjà vu"
    assert N.basic("Hi (there) <x> You!", split_letters=False).strip() == "hi you"
    assert N.asr("I'm 5, uh, (laughs) okay.") == "i am five okay" and N.asr_chinese("hello你好") == "hello 你 好"
    assert N.thai("ab cd", frozenset(["ab"])) == "ab c d" and set(N.FAMILIES) >= {"asr", "thai"}


def brute_distance(r, p):
    row = list(range(len(p) + 1))
    for i, a in enumerate(r, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(p, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_word_edits_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        r, p = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        h, s, d, i = S.edit_counts(" ".join(r), " ".join(p))
        assert s + d + i == brute_distance(r, p) and h + s + d == len(r) and h + s + i == len(p)


def test_corpus_scores(spark):
    d = spark.createDataFrame([("a b c d e", "a b c d e"), ("the cat sat", "the cat"), (None, "x"), ("", "")], "r string, p string")
    w = S.word_error_rate(d, "r", "p").first()
    assert (w.errors, w.words) == (2, 10)
    assert S.corpus_bleu(d.limit(1), "p", "r").first().bleu == pytest.approx(1.0)
    assert S.corpus_bleu(d.limit(0), "p", "r").first().bleu == 0.0
    assert S.meteor("the cat sat", "the cat sat") > 0.98 and S.meteor("x", "y") == 0 and S.rouge_l("a b c", "a c") == pytest.approx(0.8)
    assert one(spark, ["a", "b", "c"], lambda x: S.ngrams(x, 2), "array<string>") == ["a b", "b c"] and one(spark, ["a"], lambda x: S.ngrams(x, 2), "array<string>") == []


def test_signals(spark):
    x = [0.0, 0.5, -1.0, 0.25, 0.5]
    k = "array<float>"
    assert one(spark, x, lambda c: A.pad_or_cut(c, 7), k) == [*x, 0.0, 0.0] and one(spark, x, lambda c: A.pad_or_cut(c, 2), k) == x[:2]
    assert one(spark, x, lambda c: A.chunks(c, 2), k) == [x[:2], x[2:4], [0.5, 0.0]] and one(spark, x, lambda c: A.chunks(c, 2, False), k) == [x[:2], x[2:4]]
    assert one(spark, [], lambda c: A.chunks(c, 2), k) == [] and one(spark, x, A.peak, k) == 1.0
    assert one(spark, x, lambda c: A.valid_audio(c, 10), k) is True and one(spark, [*x, float("nan")], lambda c: A.valid_audio(c, 10), k) is False and one(spark, [], lambda c: A.valid_audio(c, 10), k) is False
    assert one(spark, [0.0] * 500, A.silent, k) is True and one(spark, [1.0] * 500, A.silent, k) is False
    assert one(spark, x, lambda c: A.resample(c, 10, 20), k)[:4] == pytest.approx([0.0, 0.25, 0.5, -0.25])
    assert one(spark, [[1.0, 3.0], [3.0, 5.0]], A.mono, "array<array<float>>") == [2.0, 4.0]
    assert one(spark, 30, lambda c: A.frame_indices(c, F.lit(25.0)), "int") == [10, 20] and one(spark, 100, lambda c: A.frame_indices(c, F.lit(25.0)), "int") == [0, 33, 66, 100]
    assert one(spark, 15, lambda c: A.even_indices(c, 8), "int") == [0, 2, 4, 6, 8, 10, 12, 14]
    assert one(spark, 0, lambda c: A.second_label(c, True), "int") == "0:00-1:00" and math.isclose(one(spark, x, lambda c: A.scaled(c)[2], k), -32768.0)
