"""Parts that need no session, against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavemill.llm import bpe, compare, defects, endings, labelmodel, lexicon, mixing, near, overlap, packing, repetition, splits, truncation
from wavemill.llm.common import words


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.FILE}")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoding_equals_the_public_library(reference):
    rng = random.Random(1)
    texts = ["", None, "<|endoftext|> x", "a" * 3000, "abcdefghij" * 400, " \n\n\t x  ", "né​‍🏽ab " * 30, "don't WE'LL", "日本語のテキスト、ไทย", "a\x1cb \x1d\x0b\x0c\x85"]
    texts += ["".join(rng.choice("etaoin shrdlu.,0123ABC\nпривет日本 ") for _ in range(80)) for _ in range(3000)]
    encoder = bpe.SpeculativeBpe()
    assert encoder.encode_batch(texts) == reference(texts)
    assert encoder.count_batch(texts) == [len(x) for x in reference(texts)]
    assert 0 < encoder.merged_words < encoder.proposed_words  # some guesses fail, most stand


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoding_of_any_text(texts):
    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.FILE}") if not hasattr(test_encoding_of_any_text, "t") else test_encoding_of_any_text.t
    t.encode_special_tokens = True
    test_encoding_of_any_text.t = t
    assert bpe.encoder().encode_batch(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_pair_fits_if_merging_its_bytes_gives_the_pair():
    e = bpe.encoder()
    of = {v: k for k, v in e.vocab.items()}
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    assert e.fits(a, b).tolist() == [e.merge(of[int(x)] + of[int(y)]) == [x, y] for x, y in zip(a, b)]


def test_hilbert_key_is_a_walk_through_all_points():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_filler_never_overfills():
    f, used, rng = packing.Filler(100, 0), Counter(), random.Random(2)
    seen = {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        box, at = f.place(n)
        assert at == used[box]
        used[box] += n
        seen[box] = True
    assert max(used.values()) <= 100 and sum(used.values()) / (100 * len(seen)) > 0.97


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000, 4097])
def test_permutation(size):
    out = mixing.permute(np.arange(size), size, 5)
    assert sorted(out) == list(range(size))


def test_mixture_plan_keeps_caps_and_shares():
    have = {"a": (100_000, 200), "b": (1_000, 2), "c": (0, 0)}
    rows = mixing.draw_plan(have, [("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 1)], 500, 1000)
    slots, shards = Counter(), 0
    for _, shard, n, source, first, drawn, _ in rows:
        assert shard == shards and all(f == slots[s] for s, f in zip(source, first))
        shards += n
        slots.update(dict(zip(source, drawn)))
    assert dict(slots) == {"a": 15, "b": 6} and shards == 11
    assert mixing.draw_plan({}, [("a", 1.0, 1)]) == []
    big = mixing.draw_plan({"a": (10**13, 2 * 10**10), "b": (10**13, 2 * 10**10)}, [("a", 0.5, 1), ("b", 0.5, 1)], 500, 10_000)
    assert len(big) == mixing.BUNDLES and sum(sum(r[5]) for r in big) == 4 * 10**10 and sum(r[2] for r in big) == 2 * 10**9


def test_anchors_keep_their_accuracy_and_others_are_measured_by_them():
    rng = np.random.default_rng(1)
    case = rng.random(5000) < 0.1
    noisy = np.where(rng.random(5000) < 0.2, ~case, case)
    votes, counts = np.unique(np.where(np.stack([case, noisy, noisy], 1), 1, -1), axis=0, return_counts=True)
    post, accuracy = labelmodel.fit(votes, counts, anchors={0: 1 - 1e-9})
    assert ((post >= 0.5) == (votes[:, 0] > 0)).all() and abs(accuracy[0, 1] - 0.8) < 0.05 and abs(accuracy[1, 1] - 0.8) < 0.05


def test_label_model_finds_the_better_rule():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.1
    good = np.where(rng.random(20000) < 0.95, np.where(y, 1, -1), np.where(y, -1, 1))
    poor = np.where(rng.random(20000) < 0.65, np.where(y, 1, -1), np.where(y, -1, 1))
    half = np.where(rng.random(20000) < 0.5, 0, np.where(rng.random(20000) < 0.9, np.where(y, 1, -1), np.where(y, -1, 1)))
    votes, counts = np.unique(np.stack([good, poor, half], 1), axis=0, return_counts=True)
    post, accuracy = labelmodel.fit(votes, counts)
    assert accuracy[1][0] > accuracy[1][1]
    by = {tuple(v): p for v, p in zip(votes, post)}
    assert by[1, 1, 1] > 0.9 and by[-1, -1, -1] < 0.05 and by[-1, 1, 0] < 0.5


def brute_repeated(text: str) -> tuple[int, int]:
    w = [x.lower() for x in repetition.WORD.findall(text) if not x.isnumeric()]
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            mark[i : i + 5] = [1] * 5
        seen.add(g)
    return len(w), sum(mark)


def test_repeated_words_equal_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef 12 gh.".split()) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "x", "a b c d e " * 2000, "É é " * 9]
    m = repetition.Runs().measure(texts)
    assert list(zip(m["words"].tolist(), m["repeated"].tolist())) == [brute_repeated(t) for t in texts]


def test_bags_number_repeated_words():
    a, b, d, e = near.Bags().of(["x y x", "y x x", "x y", ""])
    assert a.tolist() == b.tolist() and len(set(a.tolist())) == 3 and set(d.tolist()) < set(a.tolist()) and len(e) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([0.5, 0.7, 0.8, 0.9]))
def test_every_similar_pair_shares_a_signature_in_the_right_roles(seed, size, threshold):
    """Also where words are so frequent that only combinations of four are indexed, and for texts of a word or two."""
    rng = np.random.default_rng(seed)
    vocabulary = np.sort(rng.choice(2**31, 60, replace=False).astype(np.int64))
    base = rng.choice(vocabulary, min(size, 50), replace=False)
    sets = []
    for _ in range(12):
        s = set(base.tolist())
        for _ in range(int(rng.integers(0, max(2, size // 3)))):
            if rng.random() < 0.5 and len(s) > 1:
                s.discard(rng.choice(sorted(s)))
            else:
                s.add(int(rng.choice(vocabulary)))
        sets.append(np.sort(np.array(sorted(s), np.int64)))
    levels = np.zeros(near.COUNTERS, np.uint16)
    levels[near.slots(vocabulary)] = rng.integers(0, near.MOST, 60)  # how many are combined, less one
    signer = near.Signer(levels, 1, threshold)
    signer.by_level = np.arange(1, near.MOST + 1)
    sig, own, flag, n = signer.sign(sets, np.zeros(len(sets), np.uint64))
    bits = near.Signer.bitmaps(sets, n)
    every = {i: set(sig[own == i].tolist()) for i in range(len(sets))}
    short = {i: set(sig[(own == i) & flag].tolist()) for i in range(len(sets))}
    t = round(threshold * 100)
    for i, j in combinations(range(len(sets)), 2):
        x, y = (i, j) if n[i] <= n[j] else (j, i)
        common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
        if common * (100 + t) >= (n[i] + n[j]) * t:
            assert short[x] & every[y]
        d = sum(int(v).bit_count() for v in (bits[i] ^ bits[j]).view(np.uint64))
        assert d <= n[i] + n[j] - 2 * common


def test_more_frequent_elements_are_combined_in_larger_numbers():
    k = near.combined(np.arange(200), 1000)
    share = np.exp2(np.arange(200) / 8) / 1000
    assert k.tolist() == [1 + sum(x > s for s in near.SHARES) if 1000 * x > near.FEW else 1 for x in share]


def test_long_records_share_signatures_with_shorter_ones_and_have_few():
    rng = np.random.default_rng(2)
    vocabulary = rng.choice(2**31, 9000, replace=False).astype(np.int64)
    levels = np.zeros(near.COUNTERS, np.uint16)
    levels[near.slots(vocabulary)] = rng.integers(0, near.MOST, 9000)
    signer = near.Signer(levels, 1, 0.7)
    signer.by_level = np.arange(1, near.MOST + 1)
    for size in (280, 299, 420, 1190, 1700, 4700, 6800):
        a = np.sort(rng.choice(vocabulary, size, replace=False))
        b = a[rng.random(size) < 0.72]
        if len(b) * 10 < size * 7:
            continue
        sig, own, flag, n = signer.sign([a, b], np.zeros(2, np.uint64))
        assert set(sig[(own == 1) & flag].tolist()) & set(sig[own == 0].tolist()) and len(sig) < 40 * size


def test_common_runs_share_a_winnowed_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(50):
        run = rng.integers(0, 30, overlap.GRAM + overlap.WINDOW - 1).astype(np.int32)
        a, b = (np.concatenate([rng.integers(100, 130, rng.integers(0, 9)), run, rng.integers(200, 230, rng.integers(0, 9))]).astype(np.int32) for _ in range(2))
        h, owner = overlap.grams([a, b])
        pick = overlap.winnow(h, owner, (h % np.uint64(3)).astype(np.int64))
        assert set(h[pick[owner[pick] == 0]].tolist()) & set(h[pick[owner[pick] == 1]].tolist())


def test_gaps_align_as_by_the_plain_table():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x, y = (rng.integers(0, 6, rng.integers(0, 90)).tolist() for _ in range(2))
        row = [0] * (len(y) + 1)
        for u in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
        assert overlap._common(x, y) == row[-1]
    long = rng.integers(0, 40, 20_000).astype(np.int32)  # repetitive, with every 50th word another
    other = long.copy()
    other[::50] = 99
    assert overlap.coverage(long, other) >= 0.98


def test_coverage_of_edits():
    x = np.arange(60, dtype=np.int32)
    y = np.concatenate([x[:20], [900, 901], x[23:50], x[51:]]).astype(np.int32)
    assert overlap.coverage(x, x) == 1.0 and overlap.coverage(x, y) == pytest.approx(56 / 60)
    assert overlap.coverage(x, x + 1000) == 0.0 and overlap.coverage(x[:0], x) == 0.0
    assert overlap.coverage(np.zeros(20000, np.int32), np.zeros(20000, np.int32)) == 1.0


def test_annealing_improves_and_keeps_a_giant_whole():
    rng = np.random.default_rng(6)
    sizes = np.r_[500, rng.integers(1, 20, 200)].astype(float)
    vectors = np.stack([sizes, sizes * (rng.random(201) < 0.5)], 1)
    target = np.array([[0.8], [0.1], [0.1]]) * vectors.sum(0)[None]
    weight = np.repeat(1 / vectors.sum(0)[None] ** 2, 3, 0)
    start = rng.integers(0, 3, 201)
    cost = lambda s: float(splits.deviation(np.stack([vectors[s == k].sum(0) for k in range(3)]), target, weight))
    best = min((splits.anneal(vectors, start, target, weight, seed) for seed in range(3)), key=cost)
    assert cost(best) < 1e-4 < cost(start)


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(5.0, 0.4, 20000))
    limit = 180
    low = np.log(x[x < limit])
    mean, sd = truncation.censored_lognormal(len(low), low.sum(), (low**2).sum(), (x >= limit).sum(), limit)
    assert abs(mean - 5.0) < 0.03 and abs(sd - 0.4) < 0.03



def _corpus(rng: random.Random, n: int) -> list[str]:
    noun, verb, end = ["piano", "drum", "bell", "engine", "kettle", "whistle"], ["rings", "rattles", "hums", "squeaks"], ["in the yard", "near the river", "behind a wall", "at night"]
    s = lambda: rng.choice(["The", "A loud", "An old"]) + f" {rng.choice(noun)} {rng.choice(verb)} {rng.choice(end)}."
    return [" ".join(s() for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_ending_model_on_held_out_texts():
    rng = random.Random(8)
    model = endings.fit(_corpus(rng, 1500))
    whole = [t.rstrip(".") for t in _corpus(rng, 300)]
    parts = []
    for t in _corpus(rng, 300):
        last = t.rstrip(".").rsplit(". ", 1)[-1]
        parts.append(t[: len(t) - 1 - rng.randint(2, len(last) - 2)].rstrip())
    right = sum(model.judge(t) < 0 for t in whole) + sum(model.judge(t) > 0 for t in parts)
    assert right / 600 > 0.9
    assert model.judge("The bell rings near [the") > 0 and model.judge("The bell rings.") < -5 and model.judge("And then it fades...") < -5
    assert model.judge('{"rating": 3, "why": "the bell') > 0 and model.judge("") < -5 and model.judge("a" * 200_000) is not None




@pytest.mark.parametrize("across", [False, True])
def test_comparison_finds_close_pairs_without_comparing_all(across, monkeypatch):
    """A signature that all rows share: what is compared is bounded by sizes and places, in tiles and pair by pair."""
    rng = np.random.default_rng(5)
    count = 900
    base = rng.integers(0, 2**63, (30, 3))
    bits = (base[rng.integers(0, 30, count)] ^ (1 << rng.integers(0, 64, (count, 3)))).astype(np.int64)
    bits[: count // 2] |= np.int64(-(2**63))  # the sign is a bit like others
    size, place, side = rng.integers(20, 60, count), rng.integers(0, 9, count), rng.integers(0, 2, count)
    sig = rng.integers(1, 3, count).astype(np.uint64) << np.uint64(60)
    packed = np.array([compare.pack(sig[i : i + 1], size[i : i + 1], int(place[i]), int(side[i]))[0] for i in range(count)])
    order = np.argsort(packed, kind="stable")
    want = set()
    for x, y in combinations(order.tolist(), 2):
        differ = sum((int(u) ^ int(v)).bit_count() if (int(u) < 0) == (int(v) < 0) else ((int(u) ^ int(v)) & (2**64 - 1)).bit_count() for u, v in zip(bits[x], bits[y]))
        small, large = sorted((size[x], size[y]))
        if sig[x] == sig[y] and differ * 170 <= (small + large) * 30 and (not across or side[x] != side[y]):
            common = -(-70 * (small + large) // 170)
            first = x if size[x] < size[y] or (size[x] == size[y] and (side[x] == 0 if across else True)) else y
            if place[first] <= small - common:
                want.add((x, y) if across and side[x] == 0 else (y, x) if across else (min(x, y), max(x, y)))
    compared = []
    close = compare.close
    monkeypatch.setattr(compare, "close", lambda *x: compared.append(int(np.maximum(x[5] - x[4], 0).sum())) or close(*x))
    for short in (0, 5, 10**6):
        monkeypatch.setattr(compare, "SHORT", short)
        compared.clear()
        got = compare.compare(packed[order], order, np.ascontiguousarray(bits[order].T), 70, across)
        assert {tuple(p) for p in got.tolist()} == want and len(want) > 100
        assert sum(compared) < count * count / 8


def test_tokens_equal_the_pattern():
    rng = random.Random(8)
    for letters in ("aB1 .,;:-'_<", "aB1 .,;:-'_<é’—中 \u3000\ud800"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
            found = endings.TOKEN.findall(text)
            assert endings.tokens_of(text) == found and endings.tokens_of(text, True) == [x.lower() for x in found]


class Languages:
    """A table of words that counts how often it is asked."""

    asked = 0

    def get_all(self, found):
        self.asked += 1
        return np.array([len(w) % 9 for w in found], np.int64)


def test_voting_compares_an_answer_once_and_looks_words_up_together(monkeypatch):
    rng = random.Random(6)
    vocabulary = "What which bell is the heard near old river? rings. twice! la campana y n a na <b> </b> \"so\" 鐘の音です。窓の外で聞こえる音は何ですか 中文字 и на".split()
    text = lambda: rng.choice(["", "", "Question: ", "<b>"]) + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\nChoices:\nA. bell"])
    records = [(text(), text(), "", rng.choice([[], [("A", "the bell rings"), ("B", text())]])) for _ in range(1500)]
    draws = np.arange(len(records), dtype=np.uint64) * np.uint64(7919)
    voter = defects.Voter(defects.Models(endings.EndModel(np.zeros(endings.SIZE, np.float32), lexicon.Memory([]), frozenset()), table := Languages()))
    voter.vote_planted(records[:1], draws[:1])  # what is planted from fixed texts is voted on once
    one = lambda q, t, c: defects.code(voter.vote([(q, defects.CHOICES.split(q, maxsplit=1)[0].strip(), t, c)])[0]["copied_question"])
    want = [one(q, t, c) if words(defects.TAGS.sub(" ", a)) and len(words(q)) >= 5 else None for q, a, t, c in records]

    compared = []
    kept = defects.Copies.__init__
    monkeypatch.setattr(defects.Copies, "__init__", lambda self, n, *rest: (compared.append(n) if rest[-1] == 4 else None, kept(self, n, *rest))[1])
    before = table.asked
    _, plants = voter.vote_planted(records, draws)
    assert [x["copied_question"] for x in plants] == want
    assert table.asked - before <= 5
    lose = sum("<" in q or q.startswith("Question") for q, _, _, _ in records)
    assert sum(compared) <= len(records) + lose < 1.8 * len(records)


def test_words_that_fit_one_refusal_are_tried_with_it():
    roles = lambda a: [any(w in x for w in words(a)) for x in defects.ROLE_SETS]
    for start in ("Nothing", "No", "It goes against", "They go against", "He stands against", "Nothing is against what I"):
        for rest in ("answer can be given.", "the guidelines", "our rulesets", "comment could be made", "the wall", "can say", "do that"):
            a = f"{start} {rest}"
            assert (defects.Voter.refusal(a, words(a), "latin", *roles(a))[0] == 1) == (defects.REFUSALS.search(a) is not None), a
