"""Operators on small tables with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wavemill.llm import components, defects, mixing, near, overlap, packing, queries, repetition, splits, tokenize, truncation
from wavemill.llm.common import words

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
T0, T1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
#: Columns whose names the operators use inside.
CLASH = {"_m": "x", "_h": 1, "n": 2, "block": 3, "sig": 4, "bag": "y", "posterior": 0.5, "evidence": 1.0, "key": 7, "tokens": 8, "seq": "z"}
QA = "qa_id bigint, file_name string, video_id string, source string, split string, question string, thinking string, answer string, choices map<string,string>, loaded_at timestamp"
LONG = "The quick engine hums near the old river while a small bell rings twice. " * 3000


def qa(spark, rows, clash=True):
    base = dict(qa_id=None, file_name=None, video_id=None, source=None, split=None, question=None, thinking=None, answer=None, choices=None, loaded_at=None)
    df = spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], QA)
    for k, v in CLASH.items() if clash else ():
        df = df.withColumn(k, F.lit(v))
    return df


def docs(spark, rows):
    df = spark.createDataFrame([(*r, T0) for r in rows], "doc_id bigint, source string, text string, loaded_at timestamp")
    for k, v in CLASH.items():
        df = df.withColumn(k, F.lit(v))
    return df


def limits(spark, *rows):
    return spark.createDataFrame(rows, "limit_id int, unit string, capacity bigint")


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_ids_of_odd_texts(spark):
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(docs(spark, [(1, None, None), (2, "s", ""), (3, "s", "hi <|endoftext|>"), (4, "s", LONG)])).collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[3] and len(got[4]) > 40_000
    assert tokenize.encode_corpus(docs(spark, [(5, None, "x"), (5, None, "x")])).count() == 2
    empty = tokenize.encode_corpus(docs(spark, [(1, None, "x")]).limit(0))
    assert empty.count() == 0 and dict(empty.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


# --- 1 -----------------------------------------------------------------------------------------------------------------


def check_packing(items: dict[int, dict[str, int]], lim, placed):
    per = defaultdict(list)
    boxes = defaultdict(list)
    for r in placed:
        per[r.limit_id, r.item_id].append(r)
        boxes[r.limit_id, r.sequence_id].append(r)
    for limit_id, unit, capacity in lim:
        for i, size in items.items():
            pieces = sorted(per[limit_id, i], key=lambda r: r.piece)
            assert [p.piece for p in pieces] == list(range(len(pieces)))
            at = 0
            for p in pieces:
                assert p.item_start == at and p.length <= capacity
                at += p.length
            assert at == size[unit]
            assert len(pieces) == (1 if size[unit] <= capacity else -(-size[unit] // capacity))
    cap = {i: c for i, _, c in lim}
    for (limit_id, _), rows in boxes.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.sequence_offset):
            assert r.sequence_offset == at
            at += r.length
        assert at <= cap[limit_id]


def test_packing(spark):
    rows = [dict(qa_id=1, thinking=None, answer=None, loaded_at=T0), dict(qa_id=2, thinking="", answer="a", loaded_at=None), dict(qa_id=3, thinking=LONG, answer="b", loaded_at=T0)]
    rows += [dict(qa_id=10 + i, thinking="word " * (i % 17), answer="same text", loaded_at=T0) for i in range(60)]
    rows += [dict(qa_id=11, thinking="older and longer", answer=None, loaded_at=datetime.datetime(2023, 1, 1)), rows[5]]
    lim = [(1, "chars", 64), (2, "tokens", 16), (3, "tokens", 4096)]
    measured = packing.qa_items(qa(spark, rows))
    items = {r.item_id: {"chars": r.chars, "tokens": r.tokens} for r in measured.collect()}
    assert len(items) == 63 and items[1] == {"chars": 1, "tokens": 1} and items[2]["chars"] == 2 and items[11]["chars"] == len("word \nsame text")
    placed = packing.pack_qa(qa(spark, rows), limits(spark, *lim, (4, "bytes", 10), (5, "chars", None), (6, "chars", 0)))
    check_packing(items, lim, placed.collect())
    report = {r.limit_id: r for r in packing.fill_report(placed, limits(spark, *lim)).collect()}
    assert set(report) == {1, 2, 3} and report[1].items == 63
    assert packing.pack_qa(qa(spark, rows).limit(0), limits(spark, *lim)).count() == 0
    assert packing.pack_qa(qa(spark, rows), limits(spark, (9, "bytes", 1))).count() == 0


def test_what_shares_a_sequence_lies_close_on_the_curve(spark):
    """Mean distance to the middle of a sequence, in ranks along the curve, against the same items shuffled."""
    import random

    rng = random.Random(6)
    items = spark.createDataFrame([(i, 1 + int(rng.expovariate(1 / 300)), 1, i * 13) for i in range(30_000)], "item_id bigint, chars bigint, tokens bigint, curve_key bigint")
    boxes = defaultdict(list)
    placed = packing.pack(items, limits(spark, (1, "chars", 1024))).collect()
    for r in placed:
        boxes[r.sequence_id].append(r.item_id)

    def distance(groups):
        of = [abs(i - sum(g) / len(g)) for g in groups if len(g) > 1 for i in g]
        return sum(of) / len(of)

    ranks = [i for g in boxes.values() for i in g]
    rng.shuffle(ranks)
    turn = iter(ranks)
    shuffled = [[next(turn) for _ in g] for g in boxes.values()]
    assert distance(boxes.values()) * 5 <= distance(shuffled)
    assert max(max(g) - min(g) for g in boxes.values()) <= packing.REACH + packing.WINDOW
    assert sum(r.length for r in placed) / (1024 * len(boxes)) > 0.97


@needs_data
def test_packing_of_the_test_data_leaves_little_room(spark):
    r = {x.limit_id: x.fill_share for x in queries.p1_fill(spark, DATA).collect()}
    assert len(r) == 4 and min(r.values()) > 0.8


# --- 2 -----------------------------------------------------------------------------------------------------------------


def pairs_with_defects():
    """600 sound pairs, varied enough to learn how answers end, and 6 of each defect with ids of its own."""
    kinds = ["loud", "quiet", "distant", "broken", "rusty", "hollow", "gentle", "sharp", "muffled", "bright"]
    things, ends = ["piano", "drum", "bell", "kettle", "whistle", "engine"], ["in the yard", "near the river", "behind a thin wall", "at the station"]
    rows = []
    for i in range(600):
        a, b, e = f"{kinds[i % 10]} {things[i // 10 % 6]}", f"{kinds[i * 7 % 9]} {things[i * 5 // 3 % 6]}", ends[i * 3 // 7 % 4]
        rows.append(dict(qa_id=i, question=f"Speakers mention a {a} and a {b} {e}. Which sound of the two is heard first when the {a} stops?", thinking=f"The {a} seems louder than the {b}, so the first sound is the {a} {e}.", answer=f"The first sound is the {a}, because the {b} follows it {e}.", loaded_at=T0))
    q = rows[0]["question"]
    bad = {
        "empty": [None, "", " \n", "N/A", "<answer></answer>", "​"],
        "refusal": ["I'm sorry, but I can't help with that.", "I cannot answer questions about this clip.", "Sorry, I have to decline this clip!", "I would rather not comment on that request.", "As a language model, I am not able to listen to audio.", "Unfortunately, this is something I must refuse."],
        "copied_question": [q, "You are asking: " + q, q.upper(), q.lower().rstrip("?"), "Q: " + q, "The question is: " + q],
        "other_language": ["Primero suena un timbre sin pausa alguna, y poco después aparece un acordeón.", "Im Hintergrund bleibt eine Geige, während ein Waldkauz langsam verschwindet.", "Au fond demeure une chorale, tandis qu'un violon disparaît lentement.", "最初に貨物列車が通り、そのあと笛が鳴ります。", "В конце дятел заглушает всё, даже скрипка.", "一开始猫头鹰逆着风声，随后货运列车经过。"],
        "truncated": ["The first sound is the rusty piano, because the", "The first sound is the loud drum, because the quiet bell follows it ne", "The first sound is the sharp kettle, bec", "The first sound is the hollow bell, because the loud drum follows it in the", "The first sound is the gentle engine, because the bright whi", "The first sound is the"],
    }
    want = {}
    for k, (kind, answers) in enumerate(bad.items()):
        for j, a in enumerate(answers):
            i = 1000 + 10 * k + j
            rows.append(dict(qa_id=i, question=q, thinking=rows[0]["thinking"], answer=a, loaded_at=T0))
            want[i] = kind
    return rows, want


def test_defects(spark):
    rows, want = pairs_with_defects()
    rows += [rows[3], dict(rows[-1], answer="The first sound is the drum.", loaded_at=datetime.datetime(2023, 1, 1))]
    got = {r.qa_id: r.defect for r in defects.one_defect(defects.defect_labels(qa(spark, rows))).collect()}
    wrong = {k for k in want if got.get(k) != want[k]}
    extra = set(got) - set(want)
    assert len(wrong) <= 3 and len(extra) <= 2, (sorted((k, want[k], got.get(k)) for k in wrong), extra)
    for i, a in [(1, 'A voice says: "I can\'t help you", while the drum follows it near the river.'), (2, "A quiet kettle")]:
        few = [dict(r, answer=a) if r["qa_id"] == i else r for r in rows]
        assert i not in {r.qa_id for r in defects.defect_labels(qa(spark, few)).collect()}
    labels = defects.defect_labels(qa(spark, rows)).collect()
    assert all(r.posterior >= min(defects.TRIED) for r in labels) and len({(r.qa_id, r.defect) for r in labels}) == len(labels)


def test_labelling_functions_are_separate_and_cutoffs_validated(spark):
    rows, want = pairs_with_defects()
    for i, a in enumerate(["The man in the clip says he cannot help with the drum.", "Please rephrase the request of the drum, or try another one.", "C. The loud dr", "Which of the two is heard first when the loud piano stops, near the river?", "Im Hintergrund rings the bell of Hintergrund."]):
        rows.append(dict(rows[0], qa_id=5000 + i, answer=a, choices={"A": "The loud piano", "C": "The loud drum"}))
    d = qa(spark, rows)
    models = defects._models(d, 20_000)
    records = [defects._record(r.get("question"), r.get("answer"), r.get("thinking"), r.get("choices")) for r in rows]
    votes = defects.Voter(models).vote(records)
    again = defects.Voter(models)
    assert votes == [again.vote([r])[0] for r in records]  # whatever batch a record is in
    for name, rules in defects.RULES.items():
        columns = {tuple(v[name][k] for v in votes) for k in range(len(rules))}
        assert len(columns) == len(rules), name
    made = defects.planted(records[:200])
    hit = {name: [v[name][0] > 0 or sum(v[name]) > 0 for v in again.vote(x)] for name, x in made.items()}
    assert all(sum(hit[n]) >= 0.8 * len(hit[n]) for n in ("empty", "refusal", "copied_question", "truncated"))
    posterior = {(n, defects.code(v[n])): 0.3 if sum(v[n]) > 0 else 0.05 for x in [votes, *map(again.vote, made.values())] for v in x for n in defects.RULES}
    cutoffs = defects.validated_cutoffs(d, models, posterior)
    assert cutoffs["empty"] == cutoffs["refusal"] == cutoffs["copied_question"] == 0.3 and set(cutoffs) == set(defects.CUTOFFS)
    assert defects.validated_cutoffs(d.limit(0), models, {}) == defects.CUTOFFS


def test_cutoffs_are_validated_on_all_records(spark):
    """Defects are planted in every record, with the votes that whole planted records get; no record is left out."""
    import numpy as np

    rows, _ = pairs_with_defects()
    rows = [dict(r, qa_id=i) for i, r in enumerate(rows * 2)]
    rows += [dict(r, qa_id=9000 + i, loaded_at=T0) for i, r in enumerate([dict(question="<b>Question: what is heard?</b>\nChoices:\nA. x", answer=LONG), dict(question="N/A"), dict(question="窓の外で聞こえる音は何ですか。鐘ですか。", answer="鐘の音です。"), dict()])]
    d = qa(spark, rows + [dict(rows[0], loaded_at=datetime.datetime(2023, 1, 1))])
    models = defects._models(d, 20_000)
    voter = defects.Voter(models)
    records = [defects._record(r.get("question"), r.get("answer"), r.get("thinking"), r.get("choices")) for r in rows]
    draws = np.arange(len(records), dtype=np.uint64) * np.uint64(7919)
    votes, plants = voter.vote_planted(records, draws)
    assert votes == voter.vote(records)
    said = lambda a: words(defects.TAGS.sub(" ", a))
    one = lambda q, a, t, c, name: defects.code(voter.vote([(q, a, t, c)])[0][name])
    for (q, a, t, c), x, draw in zip(records, plants, draws.tolist()):
        if not said(a):
            assert not any(x.values())
            continue
        assert x["empty"] == one(q, defects.EMPTIED[draw % len(defects.EMPTIED)], t, c, "empty")
        assert x["refusal"] == one(q, defects.DECLINED[draw % len(defects.DECLINED)], t, c, "refusal")
        short = defects.cut_short(a, draw)
        assert x["truncated"] == (None if short is None else one(q, short, t, c, "truncated"))
        assert x["copied_question"] == (one(q, defects.CHOICES.split(q, maxsplit=1)[0].strip(), t, c, "copied_question") if len(words(q)) >= 5 else None)
    voted = defects._voted(d, models)
    got = voted.selectExpr("count(*) as n", "count(planted_empty) as e", "count(planted_refusal) as r").first()
    assert got.n == len(rows) and got.e == got.r == sum(bool(said(a)) for _, a, _, _ in records)
    # Any one record decides: only the patterns of one kind of record have a posterior.
    asked, told = ("('latin', 0, -1)", "('latin', 1, True, False, 2, 2, True)")
    found, count = defects._foreign({asked: 30, "('latin', 1, -1)": 5}, {told: 3, "('han', 9, True, False, 0, 255, False)": 1})
    assert count == 35 and sum(found.values()) == pytest.approx(35)


def test_cutoffs_follow_defects_of_few_records(spark):
    """A cutoff is that of all records, though a sample of 400 holds next to none of the ones that differ."""
    plain = [dict(qa_id=i, question="Which of the sounds is heard near the river?", answer="The bell of the old tower rings twice.", loaded_at=T0) for i in range(4000)]
    d = qa(spark, plain, clash=False)
    models = defects._models(d, 200)
    voted = defects._voted(d, models).cache()
    patterns = {r.planted_truncated: r["count"] for r in voted.groupBy("planted_truncated").count().collect()}
    assert sum(patterns.values()) == 4000 and None not in patterns
    rare = min(patterns, key=patterns.get)
    marked = voted.select("truncated").distinct().collect()
    posterior = {("truncated", p): 0.95 for p in patterns if p != rare} | {("truncated", rare): 0.35} | {("truncated", r.truncated): 0.0 for r in marked if r.truncated not in patterns}
    cutoff = defects.validated_cutoffs(d, models, posterior, voted)["truncated"]
    assert (cutoff <= 0.35) == (round(patterns[rare] / 4000, 3) > 0)


def test_defects_of_null_long_and_no_records(spark):
    rows = [dict(qa_id=1), dict(qa_id=2, question="What?", answer=LONG, choices={"A": None}), dict(qa_id=2, question="What?", answer=LONG), dict(qa_id=3, question=LONG, answer="A. x", choices={"A": "x"})]
    got = {r.qa_id: r.defect for r in defects.one_defect(defects.defect_labels(qa(spark, rows))).collect()}
    assert got.get(1) == "empty"
    assert defects.defect_labels(qa(spark, rows).limit(0)).count() == 0


def test_words_are_counted_over_all_records(spark):
    """Also where the sample that weights are fitted on holds none of them."""
    rows = [dict(qa_id=i, question="Where is the bell of the old tower?", answer=f"Sound {i} comes from the old whistle.", loaded_at=T0) for i in range(30)]
    rows += [dict(qa_id=100 + i, question="Dónde está la campana de la torre?", answer=f"Después suena {i} un acordeón en la plaza, pero muy lejos.", loaded_at=T0) for i in range(30)]
    rows += [dict(qa_id=200, question=rows[0]["question"], answer="The sound comes near the old whis", loaded_at=T0)]
    rows += [dict(qa_id=201, question=rows[0]["question"], answer="Acordeón, plaza, suena.", loaded_at=T0)]
    rows += [dict(qa_id=202, question="What?", answer="It is loud. " * 2000 + "A zeppelin hums.", loaded_at=T0), dict(qa_id=203, question="What?", answer="It is a zepp", loaded_at=T0)]
    voted = {r.qa_id: r for r in defects.defect_votes(qa(spark, rows), sample=0).collect()}
    broken = {i: defects.decode(voted[i].truncated, 4)[2] for i in (0, 200, 203)}
    assert broken == {0: -1, 200: 1, 203: 1} and defects.decode(voted[201].other_language, 4)[2] == 1


def test_known_words_equal_brute_force(spark):
    import random

    from wavemill.llm import lexicon

    rng = random.Random(4)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 19, 20, 500]) for _ in range(900)} | {"a" * 30_000: 1}
    table = lexicon.known_table(spark.createDataFrame(list(n.items()), "word string, n bigint"))
    memory = lexicon.Memory(n.items())
    for w in [*n, "c", "", "ab", "é" * 9, "a" * 29_999]:
        want = lexicon.bucket(n.get(w, 0)) * 4 + max((lexicon.bucket(k) for x, k in n.items() if w and x != w and x.startswith(w)), default=0)
        assert table.get(w) == memory.get(w) == want, w


# --- 3 -----------------------------------------------------------------------------------------------------------------


def brute_share(t):
    w = [x for x in words(t or "") if not x.isnumeric()]
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            mark[i : i + 5] = [1] * 5
        seen.add(g)
    return sum(mark) / len(w) if w else 0.0


def test_repetition(spark):
    texts = [None, "", "  ", "one two", "The bell rings in the yard. " * 8, LONG, "Each word of this text is different from all the others before it, truly so."]
    rows = [dict(qa_id=i, thinking=t, loaded_at=T0) for i, t in enumerate(texts)] + [dict(qa_id=4, thinking="The bell rings in the yard. " * 8, loaded_at=T1)]
    got = {r.qa_id: r for r in repetition.repetition(qa(spark, rows), ["qa_id"]).collect()}
    assert {i: got[i].repeated_share for i in got} == pytest.approx({i: brute_share(t) for i, t in enumerate(texts)})
    assert {r.qa_id for r in repetition.repetitive(repetition.repetition(qa(spark, rows), ["qa_id"])).collect()} == {4, 5}
    fresh = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    block = fresh(0, 90)
    mixed = [dict(qa_id=i, thinking=fresh(i, 60), loaded_at=T0) for i in range(1, 300)] + [dict(qa_id=900 + i, thinking="The bell rings in the yard. " * 9, loaded_at=T0) for i in range(20)]
    mixed += [dict(qa_id=2000, thinking=f"{block} {fresh(400, 30)} {block}", loaded_at=T0)]  # one long block, and nothing else, repeated
    found = {r.qa_id for r in repetition.repetitive(repetition.repetition(qa(spark, mixed), ["qa_id"])).collect()}
    assert found == {2000, *range(900, 920)}
    assert repetition.repetition(qa(spark, rows).limit(0), ["qa_id"]).count() == 0


@needs_data
def test_repetition_of_the_test_data(spark):
    both = repetition.both_kinds(spark.read.parquet(f"{DATA}/generated_qa.parquet"), spark.read.parquet(f"{DATA}/generated_caption.parquet"))
    want = {(r.kind, r.rec_id) for r in both.collect() if brute_share(r.thinking) >= 0.4}
    assert want and {tuple(r) for r in queries.p3_found(spark, DATA).collect()} == want


# --- 4 and 5 ------------------------------------------------------------------------------------------------------------


def similar(a, b, t=0.7):
    x, y = Counter(words(a)), Counter(words(b))
    common = sum((x & y).values())
    return bool(x) and bool(y) and common * 100 >= t * 100 * (sum(x.values()) + sum(y.values()) - common)


TEXTS = [
    ("qa", 1, "a b c d e f g h i j", "train"), ("qa", 2, "A, b c d e f g h i J!", "valid"), ("qa", 3, "j i h g f e d c b a", None), ("qa", 4, "a b c d e f g h x y", "test"),
    ("qa", 5, "a b c d e f g x y z", "test"), ("caption", 1, "a b c d e f g h i j", "test"), ("qa", 6, None, "train"), ("qa", 7, " \t", "train"), ("qa", 8, "?!", "train"), ("qa", 9, "one", "train"), ("qa", 10, "one", "valid"),
    ("qa", 11, "one one", "valid"), ("qa", 12, LONG, "train"), ("qa", 13, LONG + " end", "test"), ("caption", 2, "a b c d e f g h i", "train"),
]


def texts(spark, rows):
    df = spark.createDataFrame([(k, i, T0, s, "src", t) for k, i, t, s in rows], "kind string, rec_id bigint, loaded_at timestamp, split string, source string, text string")
    for k, v in CLASH.items():
        df = df.withColumn(k, F.lit(v))
    return df


def brute_pairs(rows):
    return {(k, min(i, j), max(i, j)) for n, (k, i, a, _) in enumerate(rows) for k2, j, b, _ in rows[n + 1 :] if k == k2 and i != j and a and b and similar(a, b)}


def test_near_duplicates(spark):
    got = near.near_duplicates(texts(spark, TEXTS + TEXTS[:3])).collect()
    assert {(r.kind, r.id_low, r.id_high) for r in got} == brute_pairs(TEXTS)
    assert len(got) == len(brute_pairs(TEXTS))
    assert near.near_duplicates(texts(spark, TEXTS).limit(0)).count() == 0


def test_groups_of_near_duplicates(spark):
    got = {(r.kind, r.rec_id): (r.class_id, r.links) for r in near.duplicate_groups(texts(spark, TEXTS + TEXTS[:3])).collect()}
    pairs = brute_pairs(TEXTS)
    links = Counter(x for k, i, j in pairs for x in ((k, i), (k, j)))
    assert {x: n for x, (_, n) in got.items()} == {(k, i): links[k, i] for k, i, t, _ in TEXTS if t and words(t)}
    assert all(got[k, i][0] == got[k, j][0] for k, i, j in pairs) and got["qa", 3][0] == 1 and got["qa", 10][0] == 9 and got["qa", 11][0] == 11
    assert near.duplicate_groups(texts(spark, TEXTS).limit(0)).count() == 0


def test_near_duplicates_among_many_texts_of_few_words(spark):
    """Every word is frequent, so pairs and triples of words carry the search."""
    import random

    rng = random.Random(9)
    rows = []
    for i in range(400):
        if rows and rng.random() < 0.4:
            w = rows[rng.randrange(len(rows))][2].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            rng.shuffle(w)
        else:
            w = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 30))]
        rows.append(("qa", i, " ".join(w), rng.choice(["train", "valid", None])))
    got = {(r.kind, r.id_low, r.id_high) for r in near.near_duplicates(texts(spark, rows)).collect()}
    assert got == brute_pairs(rows) and len(got) > 50


def test_near_duplicates_among_many_bags_compare_less(spark, monkeypatch):
    """From MANY bags on the signatures are others, the pairs the same; of equal signatures not all rows are compared."""
    import random

    import numpy as np

    rng, rows = random.Random(4), []
    for i in range(300):
        w = rows[rng.randrange(len(rows))][2].split() if rows and rng.random() < 0.4 else [f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append(("qa", i, " ".join(w), rng.choice(["train", "valid", None])))
    want = brute_pairs(rows)
    for many in (near.MANY, 0):
        monkeypatch.setattr(near, "MANY", many)
        assert {(r.kind, r.id_low, r.id_high) for r in near.near_duplicates(texts(spark, rows)).collect()} == want and len(want) > 50
    sets = [np.sort(np.array(rng.sample(range(300), 60))) for _ in range(200)]
    levels = np.zeros(near.COUNTERS, np.uint16)
    levels[:300] = [int(8 * np.log2(max(1, 200 * 0.6 / (1 + i / 20)))) for i in range(300)]
    made = [near.Signer(levels, 200, 0.7, many).place(sets, np.zeros(200, np.uint64))[0] for many in (False, True)]
    few, more = (sum(c * c for c in Counter(x.tolist()).values()) for x in made)
    assert more < few


def test_cross_split(spark):
    split = {(k, i): s for k, i, _, s in TEXTS}
    want = {p for p in brute_pairs(TEXTS) if None not in (a := (split[p[0], p[1]], split[p[0], p[2]])) and (a[0] == "train") != (a[1] == "train")}
    found = overlap.cross_split(texts(spark, TEXTS + TEXTS[:2]))
    got = {(r.kind, r.id_low, r.id_high) for r in overlap.as_pairs(found).collect()}
    assert got == want and ("qa", 9, 10) in got and ("qa", 1, 2) in got and ("qa", 12, 13) in got and ("caption", 1, 2) in got
    assert all(0 < r.coverage <= 1 and r.similarity >= 0.7 for r in found.collect())
    report = overlap.overlap_report(found).collect()
    assert sum(r.pairs for r in report) == found.count()
    assert overlap.cross_split(texts(spark, TEXTS).limit(0)).count() == 0


def test_cross_split_without_common_runs(spark):
    """Reordered words, edits every few words and short texts share no winnowed fingerprint."""
    import random

    rng = random.Random(12)
    rows = [("qa", 9000, "bell rings loud", "train"), ("qa", 9001, "a bell rings loud", "valid")]
    for i in range(60):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randint(12, 40))]
        rows.append(("qa", 2 * i, " ".join(w), "train"))
        if i % 2:
            rng.shuffle(w)
        else:
            w[4::7] = ["edited"] * len(w[4::7])
        rows.append(("qa", 2 * i + 1, " ".join(w), rng.choice(["valid", "test", "train"])))
    split = {(k, i): s for k, i, _, s in rows}
    want = {p for p in brute_pairs(rows) if (split[p[0], p[1]] == "train") != (split[p[0], p[2]] == "train")}
    assert {(r.kind, r.id_low, r.id_high) for r in overlap.as_pairs(overlap.cross_split(texts(spark, rows))).collect()} == want and ("qa", 9000, 9001) in want and len(want) > 25


@needs_data
def test_pairs_of_the_test_data(spark):
    rows = [(r.kind, r.rec_id, r.text, r.split) for r in queries._texts(spark, DATA).select("kind", "rec_id", "text", "split").distinct().collect()]
    want = brute_pairs(rows)
    assert want and {tuple(r) for r in queries.p5_found(spark, DATA).collect()} == want
    split = {(k, i): s for k, i, _, s in rows}
    cross = {p for p in want if None not in (a := (split[p[0], p[1]], split[p[0], p[2]])) and (a[0] == "train") != (a[1] == "train")}
    assert {tuple(r) for r in queries.p4_found(spark, DATA).collect()} == cross


# --- 6 -----------------------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_nothing(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 200)] + [("z000", f"z{i:03d}") for i in range(1, 50)] + [("solo", "solo"), (None, "x"), ("b", "a"), ("a", "b")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert all(got[f"{i:04d}"] == "0000" for i in range(201)) and all(got[f"z{i:03d}"] == "z000" for i in range(50))
    assert got["solo"] == "solo" and got["b"] == got["a"] == "a" and "x" not in got
    assert components.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


IDS = [f"{c}{'0' * 9}{c}" for c in "abcdefgh"]


def test_recordings_and_splits(spark):
    a, b, c, d, e, f, g, h = IDS
    link = spark.createDataFrame([(a, b, "mirror"), (f"tar/{b}", f"  {c} ", "excerpt"), (d, e, "reply"), (f"watch?v={f}", f"{g} (0_0-1_5).mp4", "reupload"), (a, a, "mirror"), (h, None, "mirror"), (d, h, None)], "video_id string, other_id string, relation string")
    rows = [dict(qa_id=1, video_id=a, split="train"), dict(qa_id=2, video_id=f"{c}.mp4", split="test"), dict(qa_id=3, file_name=f"tar/{b} (1.5-2.5)", split=None), dict(qa_id=4, video_id=d, split="train"), dict(qa_id=5, video_id=e, split="test"), dict(qa_id=6, split="valid"), dict(qa_id=7, video_id=f, split="train"), dict(qa_id=8, file_name=f"{g} (1_5-2_5).mp4", split="valid"), dict(qa_id=1, video_id=a, split="train", loaded_at=T1)]
    made = splits.records(qa(spark, rows), link)
    assert {r.qa_id: r.recording for r in made.collect()} == {1: a, 2: a, 3: a, 4: d, 5: e, 6: None, 7: f, 8: f}
    assert {r.video_id for r in splits.straddling(made).collect()} == {a, f}
    target = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.grouped_split(made, target).collect()
    assert len(got) == 8 and len({r.split for r in got if r.recording == a}) == 1
    empty = splits.grouped_split(made.limit(0), target)
    assert empty.count() == 0 and splits.split_report(empty, target).count() == 3


def test_split_shares_with_a_giant(spark):
    rows = spark.range(6000).select(F.col("id").alias("qa_id"), F.when(F.col("id") < 2000, "giant").otherwise(F.concat(F.lit("r"), (F.col("id") % 500).cast("string"))).alias("recording"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    target = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.grouped_split(rows, target)
    assert got.groupBy("recording").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    shares = {r.split: r.share_reached for r in splits.split_report(got, target).collect()}
    assert abs(shares["train"] - 0.8) < 0.01 and abs(shares["valid"] - 0.1) < 0.01


def test_rare_and_null_labels_keep_their_share_together(spark):
    """64 labels of 31 records, whose rounded shares leave the rest away from its own: 30 records of one label each and 30 of none."""
    rest = F.col("id") >= 31 * splits.LABELS
    label = F.when(~rest, F.concat(F.lit("s"), (F.col("id") % splits.LABELS).cast("string"))).when(F.col("id") % 2 == 0, F.concat(F.lit("rare"), F.col("id").cast("string")))
    rows = spark.range(31 * splits.LABELS + 60).select(F.col("id").alias("qa_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("recording"), label.alias("source"))
    target = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.grouped_split(rows, target).join(rows.select("qa_id", "source"), "qa_id").filter("source is null or source like 'rare%'")
    share = {r.split: r["count"] / 60 for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) <= 0.06, share


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rows = [(i, "big", "word " * (5 + i % 40)) for i in range(600)] + [(1000 + i, "small", "tiny text " * 10) for i in range(20)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "small", None), (2003, "small", ""), (2004, "big", LONG), (1000, "small", "tiny text " * 10)]
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("absent", 0.3, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs(spark, rows), target, block_tokens=64, shard_tokens=500)
    got = m.collect()
    uses, room = Counter((r.doc_id, r.start) for r in got), Counter()
    assert {r.source for r in got} == {"big", "small"}
    assert max(n for (i, _), n in uses.items() if i < 1000 or i > 2000) == 1 and max(n for (i, _), n in uses.items() if 1000 <= i < 1020) == 3 and not {2002, 2003} & {i for i, _ in uses}
    for r in got:
        room[r.source, r.slot] += r.n_tokens
    assert max(room.values()) == 64 and sum(n < 64 for n in room.values()) <= 4  # only a source's last block isn't full
    report = {r.source: r for r in mixing.share_report(m, target.filter("source is not null")).collect()}
    assert report["absent"].share_reached == 0 and report["small"].most_uses == 3
    assert [tuple(r) for r in m.orderBy("shard", "source", "slot", "doc_id", "start").collect()] == [tuple(r) for r in mixing.mix(docs(spark, rows), target, block_tokens=64, shard_tokens=500).orderBy("shard", "source", "slot", "doc_id", "start").collect()]
    assert mixing.mix(docs(spark, rows).limit(0), target).count() == 0 and mixing.mix(docs(spark, rows), target.limit(0)).count() == 0


def test_blocks_are_cut_from_records_laid_end_to_end(spark):
    rows = [(i, f"s{i % 3}", 1 + i * 7 % 50) for i in range(900)] + [(5000, "s0", 12_345)]
    pieces = mixing.blocks_of(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), 64).collect()
    per, of = defaultdict(int), defaultdict(list)
    for r in pieces:
        per[r.source, r.block] += r.n_tokens
        of[r.doc_id].append((r.start, r.n_tokens))
    for i, _, n in rows:
        at = 0
        for start, k in sorted(of[i]):
            assert start == at and k > 0
            at += k
        assert at == n
    for s in ("s0", "s1", "s2"):
        total, last = sum(n for _, x, n in rows if x == s), max(b for x, b in per if x == s)
        assert last == (total - 1) // 64 and all(per[s, b] == 64 for b in range(last)) and per[s, last] == total - 64 * last


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_mixture_of_the_test_data_reaches_its_shares(spark):
    got = queries.p8_shares(spark, "/root/testdata/sf0.01").collect()
    present = [r for r in got if r.tokens]
    whole, blocks = sum(r.target_share for r in present), sum(r.tokens for r in present) / mixing.BLOCK_TOKENS
    assert present and all(abs(r.share_reached - r.target_share / whole) <= 2 / blocks for r in present), got


@needs_data
def test_mixture_of_the_test_data_keeps_its_caps(spark):
    target = spark.read.parquet(f"{DATA}/mix_targets.parquet")
    for r in queries.p8_shares(spark, DATA).collect():
        assert r.most_uses <= r.max_repeats
    assert target.count() == queries.p8_shares(spark, DATA).count()


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    import random

    rng = random.Random(10)
    noun, verb, end = ["piano", "drum", "bell", "engine", "kettle", "whistle"], ["rings", "rattles", "hums", "squeaks"], ["in the yard", "near the river", "behind a wall", "at night"]
    make = lambda: " ".join(f"The {rng.choice(noun)} {rng.choice(verb)} {rng.choice(end)}." for _ in range(rng.randint(3, 9)))
    rows, cut = [], set()
    for i in range(800):
        t = make()
        if i % 2 and len(t) > 200:
            t = t[:200]
            if not t.endswith("."):
                cut.add(i)
        rows.append((i, "limited" if i % 2 else "free", t))
    rows += [(9000, "free", None), (9001, "free", ""), (9002, None, " \n"), (9003, None, LONG), (9004, "free", "And then it fades..."), (9005, "free", "The bell rings [in the ya"), (9006, "free", "- a bell\n- a drum"), (9005, "free", "The bell rings [in the ya")]
    found = {r.doc_id: r for r in truncation.truncated(docs(spark, rows)).collect()}
    got = {i for i, r in found.items() if r.cut}
    assert len(found) == 807 and 9005 in got and not got & {9000, 9001, 9002, 9003, 9004}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut - {9005}) <= 10
    assert any(r.at_limit > 0.5 for r in found.values())
    rates = {r.source: r for r in truncation.rates(truncation.truncated(docs(spark, rows))).collect()}
    assert rates["limited"].rate > rates["free"].rate and None in rates
    assert truncation.truncated(docs(spark, rows).limit(0)).count() == 0


# --- all ----------------------------------------------------------------------------------------------------------------


@needs_data
def test_queries_have_the_stated_columns(spark):
    q = queries.queries()
    for name, columns in {"p2_found": {"qa_id": "bigint", "defect": "string"}, "p6_found": {"video_id": "string"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint"}}.items():
        assert dict(q[name](spark, DATA).dtypes) == columns
    assert all(re.match(r"p[1-9]_", n) for n in q)
