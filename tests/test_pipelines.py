from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wavemill.operators import generate as G
from wavemill.plans import pipelines as X
from wavemill.plans import queries as Q
from wavemill.streaming import events as E


def test_mining(spark, tmp_path):
    text = ["[door creaks]", "[Ann sings loudly]", "(it rings)", "[a dog, barking]", "no brackets", "[!!]", "[door creaks]"]
    subs = [{"t": t, "-start": str(i), "-dur": "2"} for i, t in enumerate(text)]
    (tmp_path / "d.json").write_text(json.dumps({"video": {"videoid": "v"}, "captions": [{"lang": "en", "subtitles": {"transcript": {"text": subs}}}]}, indent=1))
    names = spark.createDataFrame([("Ann",)], "word string")
    assert {r.text for r in X.mine(spark, str(tmp_path), names=names).collect()} == {"door creaks", "person sings loudly", "a dog, barking"}
    words = spark.createDataFrame([(w,) for w in "a dog barking door creaks".split()], "word string")
    assert {r.text for r in X.mine(spark, str(tmp_path), names=names, dictionary=words).collect()} == {"door creaks", "a dog, barking"}


def test_labels(spark):
    d = spark.createDataFrame([(0, [5, 1]), (1, [2, 1]), (2, [2]), (3, [7])], "index long, generated_text array<int>")
    labels = X.token_labels(d, [1], [2])
    assert [r.label for r in labels.orderBy("index").collect()] == [1, 1, 0, -1]
    captions = spark.createDataFrame([("a",), ("b",), ("c",)], "text string")
    again = labels.withColumn("label", F.lit(9))
    assert [(r.text, r.label) for r in X.merged_labels([labels, again], captions, ["text"]).orderBy("text").collect()] == [("a", 1), ("b", 1), ("c", 0)]


def test_combining_to_training_rows(spark, tmp_path):
    a = spark.createDataFrame([("v (1_0-5_0)", "v", "bark"), ("v (1_0-5_0)", "v", "bark"), ("v (9_0-9_5)", "v", "x"), ("w (0_0-4_0)", "w", None)], "file_name string, video_id string, caption string")
    b = spark.createDataFrame([("v (1_0-5_0)", "v", "dog"), ("v (9_0-9_5)", "v", "y")], "file_name string, video_id string, caption string")
    data = spark.createDataFrame([("v", 1.0, 4.0, "[bark]"), ("v", 9.0, 0.5, "[x]"), ("w", 0.0, 4.0, "[w]")], "video_id string, start double, duration double, text string")
    both = X.combined({"audio": a, "video": b}, data)
    assert {r.file_name for r in both.collect()} == {"v (1_0-5_0)", "v (9_0-9_5)"}
    kept = X.post_filtered(both, [spark.createDataFrame([("other",)], "filename string")])
    assert [(r.file_name, r.audio_caption, r.video_caption) for r in kept.collect()] == [("v (1_0-5_0)", "bark", "dog")]

    def store(df, k):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    made = X.captioned(kept, [("Audio", F.col("audio_caption"))], store).filter("valid").select("file_name", "parsed.*")
    rows = X.training_rows(made, ["What is heard?", "Describe it."], valid=0).collect()
    assert len(rows) == 1 and rows[0].split == "train" and len(rows[0].messages) == 2 and rows[0].target.startswith("<think>thought")
    tars = spark.createDataFrame([("000.tar", "tar/v (1.0-5.0).mp4")], "tar_file string, mp4_name string")
    assert X.with_archive(made, tars).first().tar_file == "000.tar"


def test_evaluation(spark, tmp_path):
    G.register("echo", lambda: lambda prompts, k: [p.split("|")[-1] for p in prompts])
    d = spark.createDataFrame([(1, "q|i'm 5 uh", "I am five"), (2, "q|a dog", "a big dog"), (3, "q|", None)], "id int, prompt string, reference string")
    w = X.evaluate(d, "librispeech_test_clean", "wer", str(tmp_path), "echo").first()
    assert (w.errors, w.words) == (1, 7)
    assert X.evaluate(d.limit(0), "librispeech_test_clean", "wer", str(tmp_path), "echo").first().words == 7  # kept from before
    with pytest.raises(ValueError):
        X.evaluate(d, "librispeech_test_clean", "bleu", str(tmp_path), "echo")
    j = d.withColumn("instruction", F.lit("what")).withColumn("model_prediction", F.lit("Rating: 4"))
    G.register("four", lambda: lambda prompts, k: ["Rating: 4"] * len(prompts))
    s = X.score(j, "llama3_70b_judge", judge="four").first()
    assert (s.judge_score, s.success_rate, s.rows) == (80.0, 1.0, 3)
    m = spark.createDataFrame([("cat", "the cat", ["cat", "dog"]), ("cat", "dog", ["cat", "dog"])], "reference string, model_prediction string, choices array<string>")
    assert X.score(m, "string_match").first().string_match == 50.0 and X.score(m, "meteor").first().meteor > 0
    p = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "k string, i int, reply string")
    assert X.chunked_replies(p, "k", "i", "reply").first().reply == "one two"


def test_state_is_kept_by_key_over_batches(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0.0), ("b", 1, 10.0)], "k string, t int, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: E.smoothed_state(E.parquet_stream(spark, f"{tmp_path}/in", "k string, t int, v double"), "k", "t", "v")
    E.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    spark.createDataFrame([("a", 2, 4.0)], "k string, t int, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    E.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 1, 0.0), ("b", 1, 10.0), ("a", 2, 2.0)}


def test_every_query_with_sql_is_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 70
