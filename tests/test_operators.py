from __future__ import annotations

import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from wavemill.functions import rewards as R
from wavemill.operators import generate as G
from wavemill.operators import joins as J
from wavemill.operators import metrics as M
from wavemill.operators import outliers as O
from wavemill.operators import prompts as P
from wavemill.operators import rows as W
from wavemill.sources import files, registry, sinks, tar
from wavemill.streaming import events as E


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resume_keeps_null_keys(spark):
    a, b = spark.createDataFrame([(1, 2.4), (None, 1.0), (3, 1.0)], "k int, v double"), spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 9.0)], "k int, v double")
    assert {r.k for r in J.not_done(a, b, ["k"]).collect()} == {None, 3}
    assert {r.k for r in J.not_done_by(a, b, {"k": (F.col("k"), F.col("k")), "v": (F.round("v"), F.round("v"))}).collect()} == {None, 3}


def test_numbering_is_dense_over_partitions(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert [r.position for r in J.numbered(d, ["x"]).orderBy("x").collect()] == list(range(1000))
    assert J.numbered(d.limit(0), ["x"]).count() == 0
    assert rows(J.positional(d.select("x"), ["x"], spark.createDataFrame([(2, "c"), (5000, "z")], "i bigint, v string"), "i")) == [(2, 2, "c")]


def test_band_and_cascade(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), (None, 1.0)], "k string, s double")
    right = spark.createDataFrame([("a", 1.0009, 1), ("a", 0.9995, 2), ("a", 2.0011, 3), ("b", 5.0, 4)], "k string, t double, id int")
    assert rows(J.band_first(left, right, "k", "s", "t", 0.001, ["id"], ["k", "s"]).select("k", "s", "id")) == [("a", 1.0, 1)]
    got = J.cascade(left, right, "k", [F.abs(F.col("s") - F.col("t")) < 0.0006, F.col("id") == 3], "id", ["k", "s"]).select("k", "s", "id", "rule")
    assert rows(got) == [("a", 1.0, 2, 0), ("a", 2.0, 3, 1), ("b", 1.0, 4, 2)]


def test_total_join_fails_on_a_gap(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1)], "k string, v int")
    assert rows(J.total_join(a.filter("k = 'x'"), b, "k")) == [("x", 1)]
    with pytest.raises(Exception, match="no match for y"):
        J.total_join(a, b, "k").collect()


def test_pairs_and_outer_joins(spark):
    d = spark.createDataFrame([("a", ".mp4", "1"), ("a", ".json", "2"), ("b", ".mp4", "3")], "stem string, ext string, c string")
    assert rows(J.stem_pairs(d, "stem", "ext", "c", [".mp4", ".json"])) == [("a", "1", "2")]
    x, y = spark.createDataFrame([(1, "p"), (2, None)], "k int, x string"), spark.createDataFrame([(1, "q"), (2, "r")], "k int, y string")
    assert rows(J.outer_then_not_null([x, y], "k")) == rows(x.join(y, "k", "full_outer").na.drop())


def test_first_and_last(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), ("b", 1, None)], "k string, n int, v string")
    assert rows(W.first_wins(d, ["k"], ["n"])) == [("a", 1, "y"), ("b", 1, None)] and rows(W.last_per_key(d, "k", "n")) == [("a", 2, "x"), ("b", 1, None)]
    assert rows(W.union_first([d.filter("n = 2"), d], ["k"], ["n"]).select("k", "n", "v")) == [("a", 2, "x"), ("b", 1, None)]


def test_sampling_and_shards(spark):
    d = spark.range(500).withColumnRenamed("id", "k")
    split = W.split_exact(d, "k", 100)
    assert split.filter("split = 'valid'").count() == 100 and split.count() == 500 and W.split_exact(d.limit(20), "k", 100).filter("split = 'valid'").count() == 20
    assert rows(W.sample_exact(d, "k", 10)) == rows(W.sample_exact(d.repartition(9), "k", 10))
    share = W.split_share(d, "k").filter("split = 'train'").count() / 500
    assert 0.7 < share < 0.9
    s = W.sharded(d, ["k"], 64)
    assert rows(W.shard_sizes(s, ["shard"])) == [(i, 64) for i in range(7)] + [(7, 52)]
    assert rows(W.repeat_sampler(d.limit(10).select("k"), ["k"], 4, 2, 3).groupBy("chunk").count()) == [(0, 24), (1, 24)]
    assert W.every_nth(s, "position", 5).count() == 100
    names = spark.createDataFrame([(f"{i:06d}.tar",) for i in (0, 1, 2, 5, 7, 8)] + [("99999.tar",), ("x.txt",)], "name string")
    assert rows(W.shard_patterns(names)) == [("000005.tar", 1), ("99999.tar", 1), ("{000000..000002}.tar", 3), ("{000007..000008}.tar", 2)]
    assert rows(W.shard_patterns(spark.createDataFrame([("000000.tar",)], "name string"), skip_last=True)) == []
    assert rows(W.islands(spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (4, "a"), (9, "b")], "n int, g string"), "n", ["g"])) == [("a", 1, 2, 2), ("a", 4, 4, 1), ("b", 9, 9, 1)]
    assert [r.new_name for r in W.renumbered(names, ["name"]).orderBy("name").limit(2).collect()] == ["000000.tar", "000001.tar"]


def test_centroid_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 2) for i in range(60)] + [(100, [0.0] * 8, 0), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 0)]
    e = spark.createDataFrame(v, "vec_id int, embedding array<float>, label int")
    p, r = e.filter("label = 0"), e.filter("label = 1")
    brute = {x.vec_id: x.dissimilarity for x in O.pairwise(p, r).collect()}
    fast = {x.vec_id: x.dissimilarity for x in O.mean_dissimilarity(p, r).collect()}
    assert len(fast) == 30 and fast == pytest.approx(brute)
    assert {x.vec_id: x.dissimilarity for x in O.batch_mean_dissimilarity(p, r, 1000, "vec_id").collect()} == pytest.approx(brute)
    d = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.99)], "id int, dissimilarity double")
    assert [r.id for r in O.above(d, 0.9).collect()] == [3]


def test_metrics(spark):
    d = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True), (None, "x", None)], "task string, kind string, ok boolean")
    got = {(r.dimension, r.label): r.accuracy for r in M.grouped_accuracy(d, F.col("ok"), {"task": ["a", "c"], "kind": None}, "task").collect()}
    assert got == {("task", "a"): 50.0, ("task", "c"): 0.0, ("kind", "x"): pytest.approx(66.666667), ("kind", "y"): 0.0, ("total", "total"): 50.0, ("overall", "overall"): 50.0}
    s = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.8, True), (1, 3, 0.8, True), (2, 1, 0.5, False)], "query int, target int, score double, relevant boolean")
    m = M.retrieval(s, 2).first()
    assert (m.queries, m.recall, m.mrr) == (2, 0.25, 0.25) and m.map == pytest.approx((1 / 2 + 2 / 3) / 2 / 2)
    r = spark.createDataFrame([("p", 1.0), ("p", 0.0), ("q", float("nan")), ("q", 1.0), ("one", 3.0), ("same", 2.0), ("same", 2.0)], "g string, r double")
    adv = M.group_advantage(r, "g", "r")
    assert {x.g: x.s for x in adv.groupBy("g").agg(F.round(F.sum("advantage"), 9).alias("s")).collect()} == {"p": 0.0, "q": 0.0, "one": None, "same": 0.0}
    assert M.group_advantage(r, "g", "r", scale=False).filter("g = 'one'").first().advantage == 0.0
    b = M.binary_metrics(spark.createDataFrame([(True, True), (False, True), (True, False)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (b.precision, b.recall, b.f1) == (0.5, 0.5, 0.5)
    loss = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])], "run string, step int, loss double")
    assert M.early_stop(loss, ["run"], "step", "loss", 3).first().stop_at == 4
    t = spark.createDataFrame([("s", 1.5, 1.0, 1), ("s", 1.0, 1.0, 1), ("t", 0.5, -1.0, 1), ("t", 9.0, 1.0, 0)], "sequence string, ratio double, a double, m int")
    f = lambda kind: M.clipped_surrogate(t, F.col("ratio"), F.col("a"), F.col("m"), kind=kind, longest=4).first().loss
    assert f("grpo") == pytest.approx((-1.1 + 0.8) / 2) and f("bnpo") == pytest.approx((-2.2 + 0.8) / 3) and f("dr_grpo") == pytest.approx(-1.4 / 8)


def test_prompts(spark):
    d = spark.createDataFrame([("what", ["x", "y"], {"B": "y", "A": "x"}, "t", " a ", None)], "q string, c array<string>, m map<string,string>, th string, an string, s string")
    r = d.select(P.lettered(F.col("c")).alias("l"), P.lettered_map(F.col("m")).alias("m"), P.target_text(F.col("th"), F.col("an"), F.col("s")).alias("t"), P.valid_caption(F.col("an"), F.col("th")).alias("v"), P.literal_map(F.lit("{'a b': 0.5}")).alias("lm")).first()
    assert r.l == r.m == "A. x\nB. y" and r.t == "<think>t</think>\n<semantic_elements></semantic_elements>\n<answer>a</answer>" and r.v is False and r.lm == {"a b": 0.5}
    ids = spark.createDataFrame([([5, 1, 2, 3, 9, 9],), ([4, 4],)], "ids array<int>")
    assert [x.y for x in ids.select(P.masked_labels(F.col("ids"), [1, 2, 3]).alias("y")).collect()] == [[-100] * 4 + [9, 9], [-100, -100]]
    assert [x.y for x in ids.select(P.mask_after_end(F.col("ids"), 2, True).alias("y")).collect()] == [[1, 1, 1, 0, 0, 0], [0, 0]]


def test_retries_end_and_keep_failures(spark, tmp_path):
    G.register("hopeless", lambda: lambda prompts, k: ["{}"] * len(prompts))
    d = spark.createDataFrame([(f"k{i}", f"prompt {i}") for i in range(40)], "key string, prompt string")

    def store(df, k):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    good = G.with_retries(d, "key", "prompt", store).collect()
    assert len(good) == 40 and all(r.valid for r in good) and max(r.attempt for r in good) == 3
    bad = G.with_retries(d, "key", "prompt", store, model="hopeless", attempts=2).collect()
    assert len(bad) == 40 and not any(r.valid for r in bad)
    j = spark.createDataFrame([('{"thinking": "t", "answer": "a"}',), ('{"thinking": "t"}',), ("no",), ('{"thinking": "t", "answer": " "}',), (None,)], "reply string")
    assert [r.valid for r in G.parsed(j, "reply", G.CAPTION, ["thinking", "answer"]).collect()] == [True, False, False, False, False]


def test_tar_round_trip(spark, tmp_path):
    d = W.sharded(spark.range(25).select(F.format_string("v%02d (1.5-2.0)", "id").alias("stem")), ["stem"], 10)
    both = d.select("shard", F.concat("stem", F.lit(".mp4")).alias("name"), F.encode("stem", "utf-8").alias("content")).unionByName(d.select("shard", F.concat("stem", F.lit(".json")).alias("name"), F.lit(b"{}").alias("content")))
    tar.write(both, f"{tmp_path}/a")
    assert sorted(os.listdir(f"{tmp_path}/a")) == ["000000.tar", "000001.tar", "000002.tar"]
    back = tar.read(spark, f"{tmp_path}/a")
    assert back.count() == 50 and back.filter("ext = 'mp4'").select(F.col("content").cast("string").alias("c"), "stem").filter("c = stem").count() == 25
    assert back.filter(F.col("archive") == f"{tmp_path}/a/000001.tar").count() == 20 and tar.read(spark, f"{tmp_path}/a", ["000002.tar"]).count() == 10
    assert all(r.complete for r in tar.counts(back, ["mp4", "json"]).collect())
    tar.write(tar.rename_members(back), f"{tmp_path}/b")
    with tarfile.open(f"{tmp_path}/b/000000.tar") as t:
        assert sorted(t.getnames())[0] == "v00 (1_5-2_0).json"
    tar.register(spark)
    spark.readStream.format("tar").load(f"{tmp_path}/a").select("name", "size").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    assert tar.read(spark, f"{tmp_path}/none").count() == 0


def test_json_objects_over_lines(spark, tmp_path):
    o = lambda i, text, lang="en": {"video": {"videoid": f"v{i}"}, "captions": [{"lang": lang, "subtitles": {"transcript": {"text": text}}}]}
    objects = [o(1, [{"t": "[bell]", "-start": "1.5", "-dur": "2"}, {"t": "x", "-start": "bad"}]), o(2, {"t": "(one)", "-start": "0", "-dur": "1"}), o(3, [{"t": "no"}], "de"), {"other": 1}]
    (tmp_path / "dump.json").write_text("\n".join(json.dumps(x, indent=1) for x in objects))
    raw = files.concatenated_json(spark, str(tmp_path))
    assert raw.count() == 4
    assert {tuple(r) for r in files.sdh_captions(raw).collect()} == {("v1", 1.5, 2.0, "[bell]"), ("v1", None, None, "x"), ("v2", 0.0, 1.0, "(one)")}


def test_csv_and_lists(spark, tmp_path):
    d = spark.createDataFrame([("v", 1.0, 2.0, 'a "b", c'), ("w", 1e7, 0.5, "plain")], files.SDH)
    sinks.write_caption_dump(d, f"{tmp_path}/dump", "overwrite")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/dump").collect())
    assert lines == ['v,1.0,2.0,"a ""b"", c"', "w,10000000.0,0.5,plain"]
    assert rows(files.csv(spark, f"{tmp_path}/dump", files.SDH, header=False)) == rows(d)
    sinks.write_jsonl(d, f"{tmp_path}/j", "overwrite")
    assert rows(files.jsonl(spark, f"{tmp_path}/j", files.SDH)) == rows(d)
    sinks.write_chunks(spark.range(25), f"{tmp_path}/c", 10)
    assert files.listing(spark, f"{tmp_path}/c").filter("name like '%.parquet'").count() >= 3
    assert len(registry.BENCHMARKS) == 73 and registry.BENCHMARKS["covost2_en_zh_test"].metrics == ("bleu",)


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 2, float(i)) for i in range(20)], "id int, t string, k int, v double").withColumn("t", F.to_timestamp("t"))
    d.write.parquet(f"{tmp_path}/in")
    schema = "id int, t timestamp, k int, v double"
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    E.run_available(E.unique(E.parquet_stream(spark, f"{tmp_path}/in", schema), ["id"]), out, cp)
    assert spark.read.parquet(out).count() == 20
    d.withColumn("id", F.col("id") + 10).write.mode("append").parquet(f"{tmp_path}/in")
    E.run_available(E.unique(E.parquet_stream(spark, f"{tmp_path}/in", schema), ["id"]), out, cp)
    assert spark.read.parquet(out).count() == 30
    E.flush_batches(E.parquet_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/flush", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/flush").count() == 40
    assert E.tumbling(d, "t", "10 minutes", ["k"], "v").count() == 4 and E.sessions(d, "t", "90 seconds", ["k"]).count() == 20


def test_shard_patterns_of_every_supplier(spark, tmp_path):
    from wavemill.plans.queries import QUERIES

    kept = [(7, 1), (7, 2), (7, 2), (8, 2), (8, 3), (9, 5), (9, 999_999), (9, 1_000_000), (9, 1_000_001), (None, 4)]
    spark.createDataFrame(kept, "l_suppkey bigint, l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(QUERIES["q77_shard_patterns_all"](spark, str(tmp_path)))
    assert sorted(got) == [("p7-{000001..000002}.tar", 2), ("p8-{000002..000003}.tar", 2), ("p9-000005.tar", 1), ("p9-999999.tar", 1), ("p9-{1000000..1000001}.tar", 2)]


def test_normalising_texts_of_any_characters_equals_brute_force(spark, tmp_path):
    import re

    from wavemill.functions import text as T
    from wavemill.plans.queries import QUERIES

    texts = ["Uh, it's 5 o'clock", "“Um” — I'm 20, café 7", "é5 5é naïve um", "forum éum umé ER", "don't… 11–12 ah", "é uh", "", "5\n\u00a0um", "日5 um日"]
    spark.createDataFrame([*[(i, "en", t) for i, t in enumerate(texts)], (90, "fr", "um"), (91, "en", None)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def words(t):
        for k, v in [*T.DIGIT_WORDS.items(), *T.CONTRACTIONS.items()]:
            t = re.sub(rf"\b{k}\b", v, t)
        return t

    got = {r.doc_id: (r.words, r.spoken) for r in QUERIES["q78_normalise_all"](spark, str(tmp_path)).collect()}
    assert got == {i: (words(t.lower()), re.sub(T.FILLERS, "", t.lower())) for i, t in enumerate(texts)}


def test_counts_of_rare_ngrams(spark, tmp_path):
    from wavemill.plans.queries import QUERIES

    spark.createDataFrame([(1, "a b c d"), (2, "A b  c"), (2, "A b  c"), (3, "a b"), (4, None)], "caption_id bigint, answer string").write.parquet(f"{tmp_path}/generated_caption.parquet")
    assert sorted(rows(QUERIES["q79_ngram_counts_all"](spark, str(tmp_path)))) == [("a b c", 2), ("b c d", 1)]


def test_row_numbers_of_many_rows_with_payload(spark):
    """The borders of range partitions are drawn from a sample: rows with and without their payload must not be cut twice."""
    d = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    got = J.numbered(d, ["k"]).select("k", "position", "text").agg(F.count_distinct("position").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"), F.count_distinct("text").alias("t")).first()
    assert tuple(got) == (1_000_000, 0, 999_999, 1_000_000)
    few = J.numbered(d.filter("k % 997 = 0"), ["k"]).orderBy("position").collect()
    assert [r.k for r in few] == sorted(r.k for r in few) and [r.position for r in few] == list(range(len(few)))
    assert J.numbered(d.limit(0), ["k"]).count() == 0


def test_running_sums_before_each_row(spark):
    d = spark.createDataFrame([(i, None if i == 3 else i * 2) for i in range(200)], "k int, n int")
    got = [r.before for r in J.summed_before(d, ["k"], "n", "before").orderBy("k").collect()]
    want, total = [], 0
    for i in range(200):
        want.append(total)
        total += 0 if i == 3 else i * 2
    assert got == want


def test_cascade_of_equalities_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([5, 6])) for i in range(60)]
    right = [(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([5, 7]), j) for j in range(30)]
    l = spark.createDataFrame(left, "i int, k string, s int, e int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, t int, u int, id int")
    s, e = (F.col("s"), F.col("t")), (F.col("e"), F.col("u"))
    got = {x.i: (x.rule, x.id) for x in J.cascade(l, r, "k", [[s, e], [s], [e]], "id", ["i"]).collect()}
    same = lambda a, b: a is not None and a == b
    want = {}
    for i, k, a, b in left:
        best = min(((0 if same(a, t) and same(b, u) else 1 if same(a, t) else 2 if same(b, u) else 3, j) for k2, t, u, j in right if k2 == k), default=None)
        if best:
            want[i] = best
    assert got == want


def test_exact_share_clamp_and_least_rows(spark):
    d = spark.createDataFrame([(i % 40, "a" if i < 3 else None if i < 10 else "b") for i in range(57)], "k int, g string")
    assert W.split_share_exact(d, "k").filter("split = 'valid'").count() == 12 and W.split_share_exact(d, "k").count() == 57
    assert W.split_share_exact(d.limit(0), "k").count() == 0
    x = spark.createDataFrame([(-2.0,), (0.5,), (9.0,), (None,), (float("nan"),)], "x double")
    assert [str(r[0]) for r in x.select(W.clamp(F.col("x"), 0.0, 1.0)).collect()] == ["0.0", "0.5", "1.0", "None", "nan"]
    assert sorted({str(r.g) for r in W.with_least_rows(d, "g", 5).collect()}) == ["None", "b"]


def test_tar_stream_reads_an_archive_that_sorts_before_those_read(spark, tmp_path):
    def archive(name, member):
        d = spark.createDataFrame([(0, member, b"x")], "shard int, name string, content binary")
        tar.write(d, f"{tmp_path}/one")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.replace(f"{tmp_path}/one/000000.tar", f"{tmp_path}/in/{name}")

    def run():
        spark.readStream.format("tar").load(f"{tmp_path}/in").select("name").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    tar.register(spark)
    for name, member in (("b.tar", "x.txt"), ("a.tar", "y.txt"), ("c.tar", "z.txt")):
        archive(name, member)
        run()
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x.txt", "y.txt", "z.txt"]


def test_named_members_and_rewriting_of_archives(spark, tmp_path):
    d = spark.createDataFrame([(i % 3, f"v{i:02d}.txt", str(i).encode()) for i in range(30)], "shard int, name string, content binary")
    tar.write(d, f"file://{tmp_path}/a")
    got = tar.read(spark, f"{tmp_path}/a", ["000001.tar"], ["v04.txt", "v28.txt", "v00.txt"]).orderBy("name").collect()
    assert [(r.name, bytes(r.content), r.position) for r in got] == [("v04.txt", b"4", 1), ("v28.txt", b"28", 9)]
    wanted = spark.createDataFrame([("000000.tar", "v03.txt"), ("000002.tar", "v29.txt")], "archive string, name string")
    assert sorted((r.name, bytes(r.content)) for r in tar.members_of(spark, f"{tmp_path}/a", wanted).collect()) == [("v03.txt", b"3"), ("v29.txt", b"29")]
    tar.rewrite(tar.read(spark, f"{tmp_path}/a", ["000001.tar"]).select(F.lit(1).alias("shard"), F.upper("name").alias("name"), "content"), f"{tmp_path}/a")
    assert sorted(os.listdir(f"{tmp_path}/a"))[-3:] == ["000000.tar", "000001.tar", "000002.tar"]
    assert {r.name for r in tar.read(spark, f"{tmp_path}/a", ["000001.tar"]).collect()} == {f"V{i:02d}.TXT" for i in range(1, 30, 3)} and tar.read(spark, f"{tmp_path}/a").count() == 30


def test_pairs_with_semantic_elements_and_choices(spark):
    row = "struct<question:string,thinking:string,semantic_elements:string,answer:string,choices:map<string,string>>"
    long = "long enough a text"
    rows = [(long, long, long, long, {"A": "x", "B": "y"}), (long, long, "short", long, {"A": "x", "B": "y"}), (long, long, long, long, {"A": "x"}), (long, long, long, long, {"A": "x", "B": " "}), (long, long, long, long, None)]
    d = spark.createDataFrame([(r,) for r in rows], f"p {row}")
    assert [r[0] for r in d.select(P.valid_pair(F.col("p"), semantic=True, choices=["A", "B"])).collect()] == [True, False, False, False, False]
    m = spark.createDataFrame([("""{'a "b"': 0.5, "Child's voice": 0.75}""",), ("{'x': 1}",), ("no",), (None,)], "t string")
    assert [r[0] for r in m.select(P.literal_map(F.col("t"))).collect()] == [{'a "b"': 0.5, "Child's voice": 0.75}, {"x": 1.0}, None, None]


def test_numbers_and_sums_of_rewards(spark):
    d = spark.createDataFrame([("<answer>1,000</answer>", "1000.0"), ("<answer>3/4</answer>", "75%"), ("<answer>x</answer>", "y"), ("<answer>abc</answer>", "abc")], "c string, a string")
    assert [r[0] for r in d.select(R.symbolic_accuracy(F.col("c"), F.col("a"))).collect()] == [1.0, 1.0, 0.0, 0.75 + 0.0]
    x = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    assert [str(r[0]) for r in x.select(R.weighted_sum([F.col("a"), F.col("b")], [1.0, 0.5])).collect()] == ["2.0", "nan", "None"]


def test_brackets_with_an_n_stay(spark):
    """The span's class holds the letter n, in the column and in the text form alike."""
    x = spark.createDataFrame([("a [sigh] b [noise] c",)], "t string")
    from wavemill.functions import normalize as N
    from wavemill.functions import text as T

    assert x.select(T.no_bracket_spans(F.col("t"))).first()[0] == "a  b [noise] c"
    assert N.through("a [sigh] b [noise] c", N.words_only) == "a  b noise c"
    assert x.select(T.without_phrases(F.lit("the speaker is from the UK."), ["the speaker is from", "the speaker is"])).first()[0] == "the UK."
