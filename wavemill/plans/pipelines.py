"""The end-to-end flows: caption mining, combining feature outputs and generation, evaluation, training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import normalize as N
from ..functions import rewards as R
from ..functions import scoring as S
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import generate as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import rows as W
from ..sources import files
from ..sources.registry import BENCHMARKS

c = F.col


# --- captions out of subtitle dumps -------------------------------------------------------------------------------------


def bracketed(captions: DataFrame, shortest: float = 1, longest: float = 10) -> DataFrame:
    """Captions that stand in brackets as a whole, last 1 to 10 seconds and hold a word."""
    x = c("text")
    return captions.filter(T.is_bracketed(x) & c("duration").between(shortest, longest) & T.has_word_character(x) & ~x.contains('"""'))


def token_labels(ids: DataFrame, yes: list[int], no: list[int], column: str = "generated_text") -> DataFrame:
    """Adds label: 1 if a reply holds a yes token, else 0 if it holds a no token, else -1."""
    has = lambda tokens: F.arrays_overlap(c(column), F.array(*[F.lit(t) for t in tokens]))
    return ids.withColumn("label", F.when(has(yes), 1).when(has(no), 0).otherwise(-1))


def merged_labels(parts: list[DataFrame], captions: DataFrame, order: list[str]) -> DataFrame:
    """Label parts united, the first of each index kept, joined to the captions by position."""
    return J.positional(captions, order, W.union_first(parts, ["index"], ["index"]), "index")


def rule_filtered(captions: DataFrame, classified: DataFrame | None = None, how: str = "left", names: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(text): distinct captions that pass the text rules.

    classified joins on (video_id, start, duration). Tokens among the names, a short list, become 'person'. With a
    dictionary of any size all tokens must be in it.
    """
    keys = ["video_id", "start", "duration"]
    d = captions if classified is None else captions.join(classified.select(*keys).distinct(), keys, "left_semi" if how == "inner" else how)
    t = d.select(T.unbracket_first(c("text")).alias("text")).filter(T.byte_length_between(c("text"), 5, 50) & T.plain_characters(c("text")))
    if names is not None:
        listed = names.agg(F.collect_set("word").alias("_names"))
        t = t.crossJoin(F.broadcast(listed)).select(T.mask_names(c("text"), c("_names")).alias("text"))
    low = t.select(F.lower("text").alias("text"))
    low = low.filter(T.no_pronoun(c("text")) & T.strict_characters(c("text")) & (T.count_token(c("text"), "person") <= 2) & T.two_tokens(c("text")))
    out = low.select(T.replace_first(c("text"), "person person", "person").alias("text")).distinct()
    if dictionary is None:
        return out
    w = out.select("text", F.explode(F.split("text", " ")).alias("part")).withColumn("word", T.replace_first(c("part"), r"\p{Punct}", ""))
    return out.join(w.join(dictionary.select("word").distinct(), "word", "left_anti"), "text", "left_anti")


def mine(spark: SparkSession, dump: str, **rules) -> DataFrame:
    """From a dump of concatenated JSON to filtered captions."""
    return rule_filtered(bracketed(files.sdh_captions(files.concatenated_json(spark, dump))), **rules)


# --- feature outputs, filters, generation -----------------------------------------------------------------------------------


def combined(models: dict[str, DataFrame], dataset: DataFrame, order: str = "video_id") -> DataFrame:
    """Outputs of several models for the same clip, without rows that lack one, with the clip's caption from the data set.

    Each model's runs are deduplicated by file name first. The data set's key is rebuilt from id, start and end.
    """
    frames = []
    for name, df in models.items():
        one = W.first_wins(df.filter("file_name is not null"), ["file_name"], [order])
        frames.append(one.select("file_name", *[c(x).alias(f"{name}_{x}") for x in one.columns if x not in ("file_name", "video_id", "start_time", "end_time")]))
    clips = dataset.withColumn("end", c("start") + c("duration"))
    clips = clips.withColumn("file_name", K.clip_key(c("video_id"), c("start"), c("end")))
    return J.outer_then_not_null(frames, "file_name").join(W.first_wins(clips, ["file_name"], ["text"]), "file_name")


def post_filtered(df: DataFrame, dissimilar: list[DataFrame], seconds: float = 3.0, similarity: tuple[str, str] | None = None, least: float = 0.5) -> DataFrame:
    """Clips longer than so many seconds, not among the outliers, and whose two text vectors agree."""
    out = df.filter(c("end") - c("start") > seconds)
    for d in dissimilar:
        out = J.not_done(out, d.select(c("filename").alias("file_name")), ["file_name"])
    return out.filter(cosine(c(similarity[0]), c(similarity[1])) >= least) if similarity else out


def captioned(df: DataFrame, fields: list[tuple[str, Column]], store: Callable[[DataFrame, int], DataFrame], model: str = "stub", attempts: int = 5) -> DataFrame:
    """Captions by a registered model for clips that have none yet."""
    prompts = df.select("file_name", P.fields(fields, "Describe the sound.").alias("prompt"))
    return G.with_retries(prompts, "file_name", "prompt", store, model, attempts=attempts)


def with_archive(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds tar_file by the cleaned member name."""
    m = mapping.select("tar_file", K.clean_member(c("mp4_name")).alias("file_name")).distinct()
    return df.join(m, "file_name")


def training_rows(captions: DataFrame, questions: list[str], valid: int = 100, shard: int = 2048, semantic: bool = False) -> DataFrame:
    """Valid captions as (file_name, split, shard, question, target, messages), exactly so many of them in the valid split."""
    s = c("semantic_elements") if semantic else None
    good = captions.filter(P.valid_caption(c("answer"), c("thinking"), s))
    target = P.target_text(c("thinking"), c("answer"), s)
    rows = W.split_exact(good, "file_name", valid).withColumn("question", W.choose(questions, c("file_name"))).withColumn("target", target)
    rows = rows.withColumn("messages", F.when(c("split") == "train", P.conversation(c("question"), target)).otherwise(P.conversation(c("question"))))
    return W.sharded(rows.select("file_name", "split", "question", "target", "messages"), ["split", "file_name"], shard)


# --- evaluation ---------------------------------------------------------------------------------------------------------------


def chunked_replies(df: DataFrame, key: str, place: str, reply: str) -> DataFrame:
    """Replies to the pieces of a long recording, joined in order."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place, reply))).alias("r"))
    return g.select(key, F.array_join(F.transform("r", lambda x: x[reply]), " ").alias(reply))


def cascade_prompt(transcript: Column, question: Column) -> Column:
    """A text model's prompt: what was heard, then the question."""
    return F.concat(F.lit("Transcription: "), transcript, F.lit("\nQuestion: "), question, F.lit("\nAnswer: "))


def prepared(df: DataFrame, column: str, family: str) -> DataFrame:
    """The column in the form that the family's transcripts are compared in."""
    if family == "raw":
        return df
    f = N.vietnamese(c(column)) if family == "vietnamese" else N.udf(N.FAMILIES[family])(column)
    return df.withColumn(column, T.or_empty_word(f))


def score(df: DataFrame, metric: str, family: str = "raw", judge: str = "stub") -> DataFrame:
    """One table of scores of rows (reference, model_prediction[, choices, instruction])."""
    if metric == "wer":
        both = prepared(prepared(df, "reference", family), "model_prediction", family)
        return S.word_error_rate(both, "reference", "model_prediction")
    if metric == "bleu":
        return S.corpus_bleu(df, "model_prediction", "reference")
    if metric in ("meteor", "rouge_l"):
        f = S.meteor if metric == "meteor" else S.rouge_l
        return df.select(S.pair_score(f)("model_prediction", "reference").alias("s")).agg(F.avg("s").alias(metric))
    if metric == "string_match":
        m = R.string_match(c("reference"), c("model_prediction"), c("choices"))
        return df.select(m.cast("int").alias("s")).agg((F.avg("s") * 100).alias("string_match"))
    if "judge" in metric:
        binary = metric.endswith("binary")
        asked = df.withColumn("prompt", P.rubric_prompt(c("instruction"), c("reference"), c("model_prediction"), "0 or 1" if binary else "0 to 5"))
        replies = G.infer(asked, "prompt", judge)
        return M.judge_scores(replies, T.last_number(c("reply")), T.has_number(c("reply")), 100.0 if binary else 20.0)
    raise ValueError(f"unknown metric {metric}")


def evaluate(samples: DataFrame, benchmark: str, metric: str, root: str, model: str = "stub", judge: str = "stub", overwrite: bool = False) -> DataFrame:
    """Scores of a model on a benchmark. samples: (id, prompt, reference, ..). Predictions and scores are kept under root and
    used again if they exist; predictions stay with their id, so that no order is relied on."""
    spark, b = samples.sparkSession, BENCHMARKS[benchmark]
    if metric not in b.metrics:
        raise ValueError(f"{benchmark} is not scored by {metric}")
    base = f"{root.rstrip('/')}/{benchmark}-{model}"

    def kept(path: str, make: Callable[[], DataFrame]) -> DataFrame:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if overwrite or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    predictions = kept(f"{base}/predictions", lambda: G.infer(samples, "prompt", model, out="model_prediction"))
    return kept(f"{base}/{metric}", lambda: score(predictions, metric, b.preparation, judge))
