"""The engine's operators as queries over whole tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import keys as K
from ..functions import normalize as N
from ..functions import rewards as R
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import generate as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import outliers as O
from ..operators import prompts as P
from ..operators import rows as W
from ..session import scratch, spread
from ..sources import sinks, tar
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


# --- captions: rules, keys, joins ---------------------------------------------------------------------------------


@query(r"""
select distinct lower(t) as text from (select regexp_replace(regexp_replace(text, '[\[{(]', ''), '[\]})]', '') as t from sdh_captions)
where strlen(t) between 5 and 50 and regexp_matches(t, '^[A-Za-z0-9\s\p{P}]+$') and not regexp_matches(lower(t), '[^a-zA-Z0-9\s''",]')
  and not regexp_matches(lower(t), '\b(i|you|he|she|it|we|they|me|my|your)\b')""")
def q01_rule_filter(spark, sf):
    t = load(spark, sf, "sdh_captions").select(T.unbracket_first(c("text")).alias("t"))
    low = F.lower("t")
    kept = t.filter(T.byte_length_between(c("t"), 5, 50) & T.plain_characters(c("t")) & T.strict_characters(low) & T.no_pronoun(low))
    return kept.select(low.alias("text")).distinct()


@query(r"""
select video_id, start, duration, text from sdh_captions
where regexp_matches(text, '^[\[{(][^\n]*[\]})]\n?$') and duration between 1 and 10 and regexp_matches(text, '[\p{L}\p{N}_]') and not contains(text, '\"\"\"')""".replace('\\"', '"'))
def q02_bracket_captions(spark, sf):
    x = c("text")
    return load(spark, sf, "sdh_captions").filter(T.is_bracketed(x) & c("duration").between(1, 10) & T.has_word_character(x) & ~x.contains('"""')).select("video_id", "start", "duration", "text")


@query(r"""
with t as (select distinct lower(translate(text, '[]{}()', '')) as text from sdh_captions where text is not null),
w as (select text, unnest(string_split(text, ' ')) as word from t),
d as (select distinct unnest(string_split(audio_caption, ' ')) as word from audio_out where audio_caption is not null)
select text from t where len(string_split(text, ' ')) >= 2 and not exists (
  select 1 from w where w.text = t.text and not exists (select 1 from d where d.word = regexp_replace(w.word, '[!-/:-@\[-`{-~]', '')))""")
def q03_token_dictionary(spark, sf):
    """Texts all of whose parts are in a dictionary: anti-joins on parts, as the dictionary may be large."""
    t = load(spark, sf, "sdh_captions").filter("text is not null").select(F.lower(T.unbracket(c("text"))).alias("text")).distinct()
    d = load(spark, sf, "audio_out").filter("audio_caption is not null").select(F.explode(F.split("audio_caption", " ")).alias("word")).distinct()
    w = t.select("text", F.explode(F.split("text", " ")).alias("part")).withColumn("word", T.replace_first(c("part"), r"\p{Punct}", ""))
    return t.filter(T.two_tokens(c("text"))).join(w.join(d, "word", "left_anti"), "text", "left_anti")


@query(r"""
with t as (select text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from sdh_captions where text is not null),
m as (select text, list_transform(w, lambda x: case when x in ('clipped', 'pulsing', 'tender', '[tender', 'music]') then 'person' else x end) as w from t)
select text, array_to_string(w, ' ') as masked, len(list_filter(w, lambda x: x = 'person'))::bigint as persons,
  regexp_replace(array_to_string(w, ' '), 'person person', 'person') as merged from m""")
def q04_name_mask(spark, sf):
    names = F.array(*[F.lit(x) for x in ("clipped", "pulsing", "tender", "[tender", "music]")])
    m = load(spark, sf, "sdh_captions").filter("text is not null").select("text", T.mask_names(F.lower("text"), names).alias("masked"))
    return m.select("text", "masked", T.count_token(c("masked"), "person").cast("bigint").alias("persons"), T.replace_first(c("masked"), "person person", "person").alias("merged"))


@query(r"""
with t as (select qa_id, string_split(lower(answer), ' ') as w from generated_qa)
select distinct qa_id, case when list_contains(w, 'because') then 1 when list_contains(w, 'then') then 0 else -1 end::bigint as label from t where w is not null""")
def q05_token_label(spark, sf):
    t = load(spark, sf, "generated_qa").filter("answer is not null").select("qa_id", F.split(F.lower("answer"), " ").alias("w"))
    label = F.when(F.array_contains("w", "because"), 1).when(F.array_contains("w", "then"), 0).otherwise(-1)
    return t.select("qa_id", label.cast("bigint").alias("label")).distinct()


@query("""
select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by case when o_orderdate < timestamp '1995-01-01' then 0 else 1 end, o_orderkey) as n from orders) where n = 1""")
def q06_union_first_wins(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    cut = F.lit("1995-01-01").cast("timestamp")
    frames = [o.filter(c("o_orderdate") < cut), o.filter(~(c("o_orderdate") < cut))]
    return W.union_first(frames, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
select n as event_id, o_orderkey, event_type from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as n from orders) join events on event_id = n""")
def q07_positional_join(spark, sf):
    right = load(spark, sf, "events").select("event_id", "event_type")
    return J.positional(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], right, "event_id").select("event_id", "o_orderkey", "event_type")


@query("select o_orderkey, o_custkey, l_linenumber, l_quantity from orders left join lineitem on o_orderkey = l_orderkey")
def q08_left_join_fanout(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("""
with a as (select file_name, min(audio_caption) as audio_caption from audio_out group by 1),
b as (select file_name, min(answer) as caption from generated_caption group by 1), q as (select file_name, count(distinct qa_id) as questions from generated_qa group by 1)
select file_name, audio_caption, caption, questions from a full join b using (file_name) full join q using (file_name)
where file_name is not null and audio_caption is not null and caption is not null and questions is not null""")
def q09_outer_then_not_null(spark, sf):
    a = load(spark, sf, "audio_out").groupBy("file_name").agg(F.min("audio_caption").alias("audio_caption"))
    b = load(spark, sf, "generated_caption").groupBy("file_name").agg(F.min("answer").alias("caption"))
    q = load(spark, sf, "generated_qa").groupBy("file_name").agg(F.count_distinct("qa_id").alias("questions"))
    return J.outer_then_not_null([a, b, q], "file_name")


@query("""
select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'purchase') as purchase from events group by 1""")
def q10_pivot(spark, sf):
    kinds = ["click", "view", "error", "signup", "purchase"]
    p = load(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return p.select("user_id", *[F.coalesce(c(k), F.lit(0)).alias(k) for k in kinds])


CLEAN = "replace(regexp_replace(regexp_replace({0}, '^tar/', ''), '\\.mp4$', ''), '.', '_')"


@query(f"""
select distinct caption_id, {CLEAN.format('file_name')} as clip from generated_caption g
where file_name is not null and not exists (select 1 from tar_mp4_mapping m where {CLEAN.format('m.mp4_name')} = {CLEAN.format('g.file_name')})""")
def q11_anti_resume(spark, sf):
    done = load(spark, sf, "tar_mp4_mapping").select(K.clean_member(c("mp4_name")).alias("clip"))
    todo = load(spark, sf, "generated_caption").filter("file_name is not null").select("caption_id", K.clean_member(c("file_name")).alias("clip")).distinct()
    return J.not_done(todo, done, ["clip"]).select("caption_id", "clip")


@query("""
select event_id, user_id, value from events e where not exists (select 1 from events d where d.event_type = 'error' and d.user_id = e.user_id and round(d.value) = round(e.value))""")
def q12_struct_anti_rounded(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    done = e.filter("event_type = 'error'")
    return J.not_done_by(e, done, {"user": (c("user_id"), c("user_id")), "value": (F.round("value"), F.round("value"))}).select("event_id", "user_id", "value")


@query("""
with s as (select distinct video_id, start, duration, text from sdh_captions)
select video_id, start, duration, text, file_name from (
  select s.*, a.file_name, row_number() over (partition by s.video_id, s.start, s.duration, s.text order by a.start_time, a.file_name) as n
  from s join audio_out a on a.video_id = s.video_id and abs(a.start_time - s.start) <= 0.001) where n = 1""")
def q13_band_first(spark, sf):
    s = load(spark, sf, "sdh_captions").select("video_id", "start", "duration", "text").distinct()
    a = load(spark, sf, "audio_out").select("video_id", "start_time", "file_name")
    return J.band_first(s, a, "video_id", "start", "start_time", 0.001, ["start_time", "file_name"], ["video_id", "start", "duration", "text"]).select("video_id", "start", "duration", "text", "file_name")


@query("""
with a as (select file_name, any_value(video_id) as video_id, min(start_time) as s, min(end_time) as e from audio_out where file_name is not null group by 1),
r as (select distinct video_id, start, duration, text from sdh_captions where start is not null and duration is not null and text is not null)
select file_name, video_id, rule::bigint as rule, start, duration, text from (
  select a.file_name, a.video_id, r.start, r.duration, r.text, case when start = s and start + duration = e then 0 when start = s then 1 when start + duration = e then 2 else 3 end as rule,
    row_number() over (partition by file_name order by case when start = s and start + duration = e then 0 when start = s then 1 when start + duration = e then 2 else 3 end, start, duration, text) as n
  from a join r using (video_id)) where n = 1""")
def q14_fallback_match(spark, sf):
    a = load(spark, sf, "audio_out").filter("file_name is not null").groupBy("file_name").agg(F.first("video_id").alias("video_id"), F.min("start_time").alias("s"), F.min("end_time").alias("e"))
    r = load(spark, sf, "sdh_captions").na.drop(subset=["start", "duration", "text"]).select("video_id", "start", "duration", "text").distinct().withColumn("place", F.struct("start", "duration", "text"))
    start, end = (c("s"), c("start")), (c("e"), c("start") + c("duration"))
    rules = [[start, end], [start], [end]]
    return J.cascade(a, r, "video_id", rules, "place", ["file_name"]).select("file_name", "video_id", c("rule").cast("bigint").alias("rule"), "start", "duration", "text")


# --- vectors --------------------------------------------------------------------------------------------------------

PAIRWISE = """select p.vec_id, p.label, avg(1 - list_cosine_similarity(p.embedding::double[], r.embedding::double[])) as d
  from embeddings p, embeddings r where p.label < 5 and r.label >= 5 group by 1, 2"""


@query(f"select vec_id, round(d, 6) as dissimilarity from ({PAIRWISE})")
def q16_mean_dissimilarity(spark, sf):
    """All-pairs mean dissimilarity by one centroid."""
    e = load(spark, sf, "embeddings")
    return O.mean_dissimilarity(e.filter("label < 5"), e.filter("label >= 5")).select("vec_id", F.round("dissimilarity", 6).alias("dissimilarity"))


@query(f"""
with o as (select * from ({PAIRWISE}) where d > 0.9)
select label, count(*) as outliers, round(count(*) * 100.0 / (select count(*) from o), 6) as percent, round(avg(d), 6) as mean, round(max(d), 6) as largest, round(min(d), 6) as smallest from o group by 1""")
def q17_outlier_report(spark, sf):
    e = load(spark, sf, "embeddings")
    d = O.mean_dissimilarity(e.filter("label < 5"), e.filter("label >= 5"), keep=["label"])
    return O.report(d, 0.9).select("label", "outliers", *[F.round(x, 6).alias(x) for x in ("percent", "mean", "largest", "smallest")])


@query("""
select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as rank from embeddings) where rank <= 5""")
def q18_top5_per_group(spark, sf):
    e = load(spark, sf, "embeddings").select("label", "vec_id", c("embedding")[0].alias("score"))
    return W.top_per_group(e, "label", "score", "vec_id", 5).select("label", "vec_id", c("rank").cast("bigint").alias("rank"))


@query("""
with l as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings)
select vec_id, string_agg(i::varchar, ',' order by x desc, i) as places from (select *, row_number() over (partition by vec_id order by x desc, i) as n from l) where n <= 5 group by 1""")
def q19_topk_array(spark, sf):
    top = V.top_k(c("embedding"), 5)
    return load(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(top, lambda s: s.place.cast("string")), ",").alias("places"))


@query("""
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.1""")
def q20_cosine_filter(spark, sf):
    e = load(spark, sf, "embeddings")
    both = e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other")), "vec_id")
    return O.similar_pairs(both, "embedding", "other", 0.1).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
with s as (select vec_id, embedding::double[] as e, list_transform(embedding::double[], lambda x: exp(x - list_max(embedding)::double)) as x from embeddings)
select vec_id, (list_position(e, list_max(e)) - 1)::bigint as best, round(list_max(x) / list_sum(x), 6) as probability from s""")
def q21_softmax_argmax(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", V.argmax(c("embedding")).alias("best"), F.round(F.array_max(V.softmax(c("embedding"))), 6).alias("probability"))


@query("""
with l as (select video_id, unnest(map_keys(audio_tags)) as label, unnest(map_values(audio_tags)) as score from audio_out where video_id is not null),
m as (select video_id, label, avg(score) as score from l group by 1, 2)
select video_id, string_agg(label || '=' || round(score, 9)::decimal(12, 9)::varchar, ';' order by label) as items from m group by 1""")
def q22_mean_label_score(spark, sf):
    entries = F.transform(F.map_entries("audio_tags"), lambda e: F.struct(e.key.alias("label"), e.value.alias("score")))
    m = M.mean_scores(load(spark, sf, "audio_out").filter("video_id is not null").withColumn("x", entries), ["video_id"], "x")
    text = F.transform("items", lambda s: F.concat(s.label, F.lit("="), F.round(s.score, 9).cast("decimal(12,9)").cast("string")))
    return m.select("video_id", F.array_join(text, ";").alias("items"))


@query("""
with m as (select user_id, hour(ts) as h, count(*) as n from events group by 1, 2)
select user_id, string_agg(h::varchar || '-' || (h + 1)::varchar || ':' || n::varchar, ',' order by h) as hours from m group by 1""")
def q23_map_by_period(spark, sf):
    m = load(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    maps = m.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "n")))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(A.second_label(e.key), F.lit(":"), e.value.cast("string"))), ",").alias("hours"))


# --- nested data and prompts -------------------------------------------------------------------------------------------


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def q24_nested_json(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


LAST_QA = "(select * from (select *, row_number() over (partition by qa_id order by loaded_at desc) as rn from generated_qa) where rn = 1)"


def last_qa(spark, sf):
    return W.last_per_key(load(spark, sf, "generated_qa"), "qa_id", "loaded_at")


@query(f"""
with v as (select * from {LAST_QA} where file_name is not null and length(question) >= 10 and length(thinking) >= 10 and length(answer) >= 3
  and not regexp_matches(thinking, 'original (caption|data|description|title)') and not regexp_matches(answer, 'original (caption|data|description|title)'))
select file_name || '_qa_' || (row_number() over (partition by file_name order by qa_index, qa_id) - 1)::varchar as sample, qa_id from v""")
def q25_valid_pairs(spark, sf):
    """The valid pairs of a file, numbered from 0 among the valid ones."""
    part = F.struct("qa_index", "qa_id", "question", "thinking", "answer")
    files = last_qa(spark, sf).filter("file_name is not null").groupBy("file_name").agg(F.array_sort(F.collect_list(part)).alias("pairs"))
    each = files.select("file_name", F.posexplode(F.filter("pairs", lambda p: P.valid_pair(p))).alias("i", "p"))
    return each.select(F.concat("file_name", F.lit("_qa_"), c("i").cast("string")).alias("sample"), c("p.qa_id").alias("qa_id"))


@query(r"""
with a as (select file_name, min(audio_caption) as audio_caption, min(ast_classification) as ast, min(music_caption) as music from audio_out where file_name is not null group by 1)
select file_name, concat_ws(chr(10), 'Describe the sound.', case when trim(audio_caption) <> '' then 'Audio caption: ' || audio_caption end, case when trim(ast) <> '' then 'Sound class: ' || ast end,
  case when contains(lower(audio_caption), 'music') and trim(music) <> '' then 'Music caption: ' || music end) as prompt from a""")
def q26_prompt_build(spark, sf):
    a = load(spark, sf, "audio_out").filter("file_name is not null").groupBy("file_name").agg(*[F.min(x).alias(x) for x in ("audio_caption", "ast_classification", "music_caption")])
    music = P.music_line(c("audio_caption"), c("music_caption"))
    return a.select("file_name", P.fields([("Audio caption", c("audio_caption")), ("Sound class", c("ast_classification")), ("Music caption", music)], "Describe the sound.").alias("prompt"))


@query(f"""
select qa_id, '<think>' || trim(coalesce(thinking, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) || '</think>' || chr(10) || '<answer>' || trim(coalesce(answer, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) || '</answer>' as target from {LAST_QA}""")
def q27_target_format(spark, sf):
    return last_qa(spark, sf).select("qa_id", P.target_text(c("thinking"), c("answer")).alias("target"))


@query(f"""
select qa_id, 'user' || chr(31) || coalesce(question, '') || chr(30) || 'assistant' || chr(31) || coalesce(answer, '') as chat from {LAST_QA} where split = 'train'
union all select qa_id, 'user' || chr(31) || coalesce(question, '') as chat from {LAST_QA} where split <> 'train'""")
def q28_chat(spark, sf):
    """Conversations; the assistant turn only in training."""
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    turns = F.when(c("split") == "train", P.conversation(q, a)).otherwise(P.conversation(q))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\x1f"), t.content)), "\x1e")
    return last_qa(spark, sf).filter("split is not null").select("qa_id", flat.alias("chat"))


@query("""
select shard, count(*) as rows, min(doc_id) as first, max(doc_id) as last from (select doc_id, (row_number() over (order by doc_id) - 1) // 64 as shard from documents) group by 1""")
def q29_shards(spark, sf):
    s = W.sharded(load(spark, sf, "documents").select("doc_id"), ["doc_id"], 64)
    return s.groupBy(c("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""
select doc_id, case when row_number() over (order by md5('1337:' || doc_id::varchar), doc_id) <= 100 then 'valid' else 'train' end as split from documents""")
def q30_split_exact(spark, sf):
    return W.split_exact(load(spark, sf, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "split")


@query("""
with d as (select distinct l_suppkey, l_orderkey from lineitem), g as (select *, l_orderkey - row_number() over (partition by l_suppkey order by l_orderkey) as island from d)
select l_suppkey, min(l_orderkey) as first, max(l_orderkey) as last, count(*) as n from g group by l_suppkey, island""")
def q31_islands(spark, sf):
    return W.islands(load(spark, sf, "lineitem"), "l_orderkey", ["l_suppkey"])


@query("""
with n as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as i from nation)
select n_nationkey, i // 4 as chunk, p as pass, i % 4 as place, k as copy from n, range(3) r(p), range(2) s(k) where i // 4 < 25 // 4""")
def q32_repeat_sampler(spark, sf):
    r = W.repeat_sampler(load(spark, sf, "nation").select("n_nationkey"), ["n_nationkey"], 4, 2, 3)
    return r.select("n_nationkey", *[c(x).cast("bigint").alias(x) for x in ("chunk", "pass", "place", "copy")])


# --- rewards and scores ----------------------------------------------------------------------------------------------------

TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""
with q as (select qa_id, question, answer, map_values(choices) as options from {LAST_QA} where choices is not null and answer is not null),
t as (select qa_id, {TOKENS.format('map_answer')} as a, {TOKENS.format('answer')} as p, options from (select *, options[1] as map_answer from q)),
w as (select qa_id, a, p, list_filter(flatten(list_transform(options, lambda o: {TOKENS.format('o')})), lambda x: not list_contains(a, x)) as wrong from t)
select qa_id, len(p) > 0 and list_has_all(p, a) and not list_has_any(p, wrong) as matched from w""")
def q33_string_match(spark, sf):
    q = last_qa(spark, sf).filter("choices is not null and answer is not null").withColumn("options", F.map_values("choices"))
    return q.select("qa_id", R.string_match(c("options")[0], c("answer"), c("options")).alias("matched"))


@query(f"""
with b as (select coalesce(length(answer) > 80, false) as ok, split, source from {LAST_QA}),
l as (select 'split' as dimension, split as label, ok from b union all select 'source', source, ok from b union all select 'total', case when split in ('train', 'valid', 'test', 'dev') then 'total' end, ok from b union all select 'overall', 'overall', ok from b),
g as (select dimension, label, sum(ok::bigint)::bigint as correct, count(*) as rows from l where label is not null group by 1, 2),
f as (select * from (values ('split', 'train'), ('split', 'valid'), ('split', 'test'), ('split', 'dev'), ('total', 'total'), ('overall', 'overall')) v(dimension, label))
select coalesce(g.dimension, f.dimension) as dimension, coalesce(g.label, f.label) as label, coalesce(correct, 0)::bigint as correct, coalesce(rows, 0)::bigint as rows,
  round(coalesce(correct * 100.0 / rows, 0.0), 6) as accuracy from g full join f on g.dimension = f.dimension and g.label = f.label where f.label is not null or g.dimension = 'source'""")
def q34_grouped_accuracy(spark, sf):
    g = M.grouped_accuracy(last_qa(spark, sf), F.length("answer") > 80, {"split": ["train", "valid", "test", "dev"], "source": None}, "split")
    return g.select("dimension", "label", "correct", "rows", F.round("accuracy", 6).alias("accuracy"))


@query(r"""
with t as (select coalesce(lang, 'none') as lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where text is not null),
s as (select lang, try_cast(w[len(w)] as double) as v from t)
select lang, round(avg(coalesce(v, 0)) * 20, 6) as judge_score, round(avg((v is not null)::int), 6) as success_rate, count(*) as rows from s group by 1""")
def q35_judge_scores(spark, sf):
    d = load(spark, sf, "documents").filter("text is not null").withColumn("lang", F.coalesce("lang", F.lit("none")))
    s = M.judge_scores(d, T.last_number(c("text")), T.has_number(c("text")), 20.0, ["lang"])
    return s.select("lang", F.round("judge_score", 6).alias("judge_score"), F.round("success_rate", 6).alias("success_rate"), "rows")


@query(f"""
with p as (select qa_id, answer as a, case qa_id % 4 when 0 then answer when 1 then left(answer, 3) || '#' when 2 then 'xyz' || substr(answer, 4) else lower(answer) end as p from {LAST_QA} where answer is not null)
select qa_id, least(1.0, case when p = a then 0.5 else 0.0 end + case when left(p, 3) = left(a, 3) then 0.25 else 0.0 end + case when length(p) > 3 and length(a) > 3 and substr(p, 4) = substr(a, 4) then 0.25 else 0.0 end)::double as reward from p""")
def q36_partial_accuracy(spark, sf):
    a, k = c("answer"), c("qa_id") % 4
    p = F.when(k == 0, a).when(k == 1, F.concat(F.substring(a, 1, 3), F.lit("#"))).when(k == 2, F.concat(F.lit("xyz"), T.from_nth(a, 4))).otherwise(F.lower(a))
    return last_qa(spark, sf).filter("answer is not null").select("qa_id", R.partial_accuracy(p, a).alias("reward"))


@query(rf"""
with n as (select qa_id, len(list_filter(regexp_split_to_array(thinking, '\s+'), lambda x: x <> '')) as n from {LAST_QA} where thinking is not null)
select qa_id, round(greatest(0.0, least(1.0, 0.1 * (100 - n) + 0.5)), 6)::double as reward, round(greatest(0.0, least(1.0, case when n <= 100 then 1.0 - 0.1 * (100 - n) + 0.5 else 0.1 * (100 - n) + 0.5 end)), 6)::double as encouraged from n""")
def q37_length_reward(spark, sf):
    q = last_qa(spark, sf).filter("thinking is not null")
    return q.select("qa_id", F.round(R.length_reward(c("thinking")), 6).alias("reward"), F.round(R.length_reward(c("thinking"), encourage=True), 6).alias("encouraged"))


@query(r"""
with d as (select doc_id, text as x, case when contains(text, '</answer>') then trim(split_part(text, '</answer>', -1), chr(32) || chr(9) || chr(10) || chr(13)) else '' end as rest from documents where text is not null)
select doc_id, case when regexp_full_match(x, '(?s)<think>.*?</think>\s*<answer>.*?</answer>') then 0.5 else 0.0 end::double as format,
  round(greatest(0.0, case when contains(x, '<think>') and contains(x, '</think>') then 0.125 else 0.0 end + case when contains(x, '<answer>') and contains(x, '</answer>') then 0.125 else 0.0 end
    - length(rest) * 0.001 + case when contains(x, '</think>') and strpos(x, '<answer>') > strpos(x, '</think>') then 0.25 else 0.0 end), 6)::double as tags from d""")
def q38_format_rewards(spark, sf):
    x = c("text")
    return load(spark, sf, "documents").filter("text is not null").select("doc_id", R.format_reward(x).alias("format"), F.round(R.tag_count_reward(x), 6).alias("tags"))


@query("""
select event_id, round((value - avg(value) over w) / (stddev_samp(value) over w + 1e-4), 6) as advantage from events window w as (partition by user_id)""")
def q39_group_advantage(spark, sf):
    return M.group_advantage(load(spark, sf, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


# --- windows over time ---------------------------------------------------------------------------------------------------------


@query("""
select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def q40_tumbling(spark, sf):
    w = E.tumbling(load(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value")
    return w.select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end, count(*) as n from s group by user_id, s""")
def q41_sessions(spark, sf):
    return E.sessions(load(spark, sf, "events"), "ts", "30 minutes", ["user_id"])


@query()
def q42_stream_resume(spark, sf):
    """A stream of the documents, without repeats, started twice: the second run finds nothing new."""
    out = scratch(spark)
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    docs.write.parquet(f"{out}/in")
    for _ in range(2):
        E.run_available(E.unique(E.parquet_stream(spark, f"{out}/in", "doc_id bigint, source string, text string"), ["doc_id"]), f"{out}/out", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/out").select("doc_id", "source")


# --- metrics -----------------------------------------------------------------------------------------------------------------------


@query(r"""
with b as (select lang = 'en' as t, regexp_matches(text, ' the | a ') as p from documents where lang is not null and text is not null),
s as (select count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (t = p) as hit, count(*) as n from b)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(hit / n, 6) as accuracy from s""")
def q43_binary_metrics(spark, sf):
    d = load(spark, sf, "documents").filter("lang is not null and text is not null")
    m = M.binary_metrics(d, c("lang") == "en", c("text").rlike(" the | a "))
    return m.select("tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy")])


@query("""
with s as (select q.vec_id as query, t.vec_id as target, q.label = t.label as relevant, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], t.embedding::double[]), 9) desc, t.vec_id) as rank
  from embeddings q, embeddings t where q.vec_id % 50 = 0 and q.vec_id <> t.vec_id),
h as (select *, sum(relevant::int) over (partition by query order by rank) as hits from s),
p as (select query, sum(relevant::int) as n, sum((relevant and rank <= 10)::int) as top, sum(case when relevant then hits / rank else 0 end) as ap, min(case when relevant then rank end) as first from h group by 1)
select count(*) as queries, round(avg(coalesce(top / n, 0)), 6) as recall, round(avg(coalesce(ap / n, 0)), 6) as map, round(avg(coalesce(1 / first, 0)), 6) as mrr from p""")
def q44_retrieval(spark, sf):
    """Retrieval of same-label vectors; the query set is every vector whose id is divisible by 50, against all."""
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query"), V.unit(c("embedding")).alias("a"), c("label").alias("la"))
    t = e.select(c("vec_id").alias("target"), V.unit(c("embedding")).alias("b"), c("label").alias("lb"))
    s = q.join(t, c("query") != c("target")).select("query", "target", F.round(V.dot(c("a"), c("b")), 9).alias("score"), (c("la") == c("lb")).alias("relevant"))
    m = M.retrieval(s, 10)
    return m.select("queries", *[F.round(x, 6).alias(x) for x in ("recall", "map", "mrr")])


@query(r"""
with p as (select answer as t from generated_caption where split = 'valid' and answer is not null), r as (select answer as t from generated_caption where split = 'train' and answer is not null),
u as (select distinct unnest(regexp_split_to_array(lower(t), '\s+')) as w from p), v as (select distinct unnest(regexp_split_to_array(lower(t), '\s+')) as w from r)
select (select count(*) from u where w <> '') as vocabulary, round((select count(*) from u where w <> '' and w not in (select w from v)) / (select count(*) from u where w <> ''), 6) as vocabulary_novelty,
  round((select count(*) from p where t not in (select t from r)) / (select count(*) from p), 6) as caption_novelty""")
def q45_novelty(spark, sf):
    g = load(spark, sf, "generated_caption").filter("answer is not null")
    n = M.vocabulary_novelty(g.filter("split = 'valid'"), g.filter("split = 'train'"), "answer")
    return n.select("vocabulary", F.round("vocabulary_novelty", 6).alias("vocabulary_novelty"), F.round("caption_novelty", 6).alias("caption_novelty"))


def _spoken(spark, sf):
    """Captions, and the same with every seventh word lost and every fifth replaced."""
    words = F.split("answer", " ")
    heard = F.filter(F.transform(words, lambda w, i: F.when(i % 7 == 6, F.lit("")).when(i % 5 == 4, F.lit("noise")).otherwise(w)), lambda w: w != "")
    return load(spark, sf, "generated_caption").filter("answer is not null").select("caption_id", "source", c("answer").alias("reference"), F.array_join(heard, " ").alias("heard"))


@query()
def q46_word_error_rate(spark, sf):
    prepared = _spoken(spark, sf).withColumn("reference", N.udf(N.asr)("reference")).withColumn("heard", N.udf(N.asr)("heard"))
    return S.word_error_rate(prepared, "reference", "heard", ["source"])


@query(r"""
with t as (select list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') as w from (select distinct caption_id, answer from generated_caption where answer is not null)),
g as (select unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from t where len(w) >= 3)
select gram, count(*) as n from g group by 1 having count(*) >= 5""")
def q47_ngram_counts(spark, sf):
    """A report of frequent n-grams only, those seen five times or more; q79_ngram_counts_all counts all."""
    t = load(spark, sf, "generated_caption").filter("answer is not null").select("caption_id", "answer").distinct()
    return t.select(F.explode(S.ngrams(T.tokens(F.lower("answer")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 5")


def _fold(expr: str) -> str:
    for k, v in [*T.DIGIT_WORDS.items(), *T.CONTRACTIONS.items()]:
        expr = f"regexp_replace({expr}, '\\b{k.replace(chr(39), chr(39) * 2)}\\b', '{v}', 'g')"
    return expr


@query(rf"""
select doc_id, {_fold('lower(text)')} as words, regexp_replace(lower(text), '\b(uh|umm|um|er|ah)\b', '', 'g') as spoken from documents where text is not null and lang = 'en' and regexp_full_match(text, '[\x00-\x7f]*')""")
def q48_normalise(spark, sf):
    """Of texts of ASCII characters only; q78_normalise_all has the others as well."""
    d = spread(load(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").filter("text is not null and lang = 'en'").filter(c("text").rlike(r"\A[\x00-\x7f]*\z"))
    return d.select("doc_id", T.numbers_to_words(F.lower("text")).alias("words"), T.no_fillers(F.lower("text")).alias("spoken"))


@query("""
select tag, string_agg(file_name, ',' order by file_name) as files from (select distinct file_name, unnest(map_keys(audio_tags)) as tag from audio_out where file_name is not null) group by 1""")
def q49_inverted_index(spark, sf):
    a = load(spark, sf, "audio_out").filter("file_name is not null").withColumn("tags", F.map_keys("audio_tags"))
    return W.inverted_index(a, "file_name", "tags").select("tag", F.array_join("keys", ",").alias("files"))


@query()
def q50_bounded_retry(spark, sf):
    """Generation with a stub model: JSON is validated, failures are tried again, five times at most."""
    out = scratch(spark)

    def store(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{out}/attempt-{k}")
        return spark.read.parquet(f"{out}/attempt-{k}")

    clips = q26_prompt_build(spark, sf)
    return G.with_retries(clips, "file_name", "prompt", store).select("file_name", "attempt", "valid", c("parsed.answer").alias("answer"))


@query()
def q51_tar_round_trip(spark, sf):
    """Documents written to tar shards of 512 and read back."""
    out = local(scratch(spark))
    rows = W.sharded(load(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), ["doc_id"], 512)
    tar.write(rows.select("shard", F.concat(c("doc_id").cast("string"), F.lit(".txt")).alias("name"), c("text").alias("content")), f"{out}/shards")
    back = tar.read(spark, f"{out}/shards")
    return back.select(T.base_name(c("archive")).alias("archive"), c("stem").cast("bigint").alias("doc_id"), c("content").cast("string").alias("text"))


@query()
def q52_codebook(spark, sf):
    return O.codebook(load(spark, sf, "embeddings"), 8).groupBy("code").agg(F.count("*").alias("n"))


@query("""
with x as (select vec_id, embedding::double[] as e from embeddings), i as (select vec_id, e, unnest(range(0, ((len(e) + 9) // 10)::int)) as i from x)
select vec_id, i as chunk, i::varchar || '-' || (i + 1)::varchar as label, round(list_sum(e[i * 10 + 1 : i * 10 + 10]), 5) as total, 10::bigint as size from i""")
def q53_chunks(spark, sf):
    """Signals cut into pieces of 10 samples, the last one padded."""
    x = load(spark, sf, "embeddings").select("vec_id", F.posexplode(A.chunks(c("embedding"), 10)).alias("chunk", "piece"))
    total = F.aggregate("piece", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return x.select("vec_id", c("chunk").cast("bigint").alias("chunk"), A.second_label(c("chunk")).alias("label"), F.round(total, 5).alias("total"), F.size("piece").cast("bigint").alias("size"))


@query("""
with t as (select o_orderkey, list_transform(string_split(o_orderkey::varchar, ''), lambda x: x::int) as ids from orders),
p as (select *, list_position(ids, 1) as pos from t)
select o_orderkey, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: case when pos > 0 and i > pos then ids[i] else -100 end), ',') as labels,
  array_to_string(list_transform(range(1, len(ids) + 1), lambda i: case when coalesce(pos, 0) = 0 or i <= pos then 1 else 0 end), ',') as mask from p""")
def q54_token_masks(spark, sf):
    """Digits of a key as token ids: all up to the first 1 ignored; and a mask up to the first 1 as end token."""
    ids = F.transform(F.split(c("o_orderkey").cast("string"), ""), lambda x: x.cast("int"))
    o = load(spark, sf, "orders").select("o_orderkey", F.filter(ids, lambda x: x.isNotNull()).alias("ids"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return o.select("o_orderkey", text(P.masked_labels(c("ids"), [1])).alias("labels"), text(P.mask_after_end(c("ids"), 1)).alias("mask"))


# --- files and keys -----------------------------------------------------------------------------------------------------------------


@query(r"""
select concat_ws(',', video_id, start::varchar, duration::varchar, case when contains(text, ',') then '"' || replace(translate(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), ''), '"', '""') || '"'
  else replace(translate(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), ''), '"', '""') end) as value from sdh_captions""")
def q55_caption_lines(spark, sf):
    return sinks.caption_lines(load(spark, sf, "sdh_captions"))


FORM = r"'^(.+) \((\d+(?:[._]\d+)?)-(\d+(?:[._]\d+)?)\)(?:\.\w+)?$'"


@query(rf"""
with n as (select distinct mp4_name from tar_mp4_mapping where mp4_name is not null), p as (select mp4_name, regexp_replace(mp4_name, '^tar/', '') as m from n)
select mp4_name, {CLEAN.format('mp4_name')} as clip, nullif(regexp_extract(m, {FORM}, 1), '') as video_id, try_cast(replace(nullif(regexp_extract(m, {FORM}, 2), ''), '_', '.') as double) as start,
  try_cast(replace(nullif(regexp_extract(m, {FORM}, 3), ''), '_', '.') as double) as "end" from p""")
def q56_parse_keys(spark, sf):
    n = load(spark, sf, "tar_mp4_mapping").filter("mp4_name is not null").select("mp4_name").distinct()
    bare = F.when(c("mp4_name").startswith("tar/"), T.from_nth(c("mp4_name"), 5)).otherwise(c("mp4_name"))
    return n.select("mp4_name", K.clean_member(c("mp4_name")).alias("clip"), K.parse_clip(bare).alias("p")).select("mp4_name", "clip", "p.*")


@query("""
select distinct file_name, video_id || ' (' || replace(start_time::varchar, '.', '_') || '-' || replace(end_time::varchar, '.', '_') || ')' as key from audio_out""")
def q57_format_keys(spark, sf):
    a = load(spark, sf, "audio_out")
    return a.select("file_name", K.clip_key(c("video_id"), c("start_time"), c("end_time")).alias("key")).distinct()


@query("""
select tar_file, count(*) as members, count(distinct mp4_name) as names, count(*) filter (ends_with(mp4_name, '.mp4')) as with_ext, count(*) filter (starts_with(mp4_name, 'tar/')) as with_folder from tar_mp4_mapping group by 1""")
def q58_archive_counts(spark, sf):
    m = load(spark, sf, "tar_mp4_mapping")
    return m.groupBy("tar_file").agg(F.count("*").alias("members"), F.count_distinct("mp4_name").alias("names"), F.count_if(c("mp4_name").endswith(".mp4")).alias("with_ext"), F.count_if(c("mp4_name").startswith("tar/")).alias("with_folder"))


@query("""
select vec_id, len(embedding) / 64 between 0.1 and 300 and list_max(list_transform(embedding, lambda x: abs(x))) >= 0.3 as valid, round(list_max(list_transform(embedding, lambda x: abs(x)))::double, 5) as peak,
  round(list_sum(embedding[1:50]::double[]), 5) as total50 from embeddings""")
def q59_audio_checks(spark, sf):
    x = c("embedding")
    fifty = F.aggregate(A.pad_or_cut(x, 50), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return load(spark, sf, "embeddings").select("vec_id", A.valid_audio(x, 64, quiet=0.3).alias("valid"), F.round(A.peak(x).cast("double"), 5).alias("peak"), F.round(fifty, 5).alias("total50"))


@query("""
with f as (select distinct file_name, floor((end_time - start_time) * 25 + 0.5)::int as frames from audio_out where end_time > start_time and file_name is not null),
s as (select *, frames / 25.0 as sec, least(4, ceil(frames / 25.0))::int as n from f)
select file_name, frames::bigint as frames, case when sec < 2 then (frames // 3)::varchar || ',' || (frames * 2 // 3)::varchar
  else array_to_string(list_transform(range(n), lambda i: least(floor(i * case when n > 1 then frames / (n - 1) else 0 end)::int, frames)), ',') end as picked from s""")
def q60_frame_indices(spark, sf):
    f = load(spark, sf, "audio_out").filter("end_time > start_time and file_name is not null").select("file_name", F.floor((c("end_time") - c("start_time")) * 25 + 0.5).cast("int").alias("frames")).distinct()
    return f.select("file_name", c("frames").cast("bigint").alias("frames"), F.array_join(F.transform(A.frame_indices(c("frames"), F.lit(25.0)), lambda i: i.cast("string")), ",").alias("picked"))


@query(r"""
with w as (select unnest(regexp_split_to_array(lower(audio_caption), '\s+')) as w from audio_out where audio_caption is not null), k as (select w, count(*) as n from w where w <> '' group by 1)
select count(*) as vocabulary, round(count(*) / sum(n), 6) as diversity from k""")
def q61_vocabulary(spark, sf):
    d = M.vocabulary_diversity(load(spark, sf, "audio_out").filter("audio_caption is not null"), "audio_caption")
    return d.select("vocabulary", F.round("diversity", 6).alias("diversity"))


@query("""
with r as (select case when event_id % 10 = 0 then null else value end as v, case when event_type = 'click' then 1.0 else 0.0 end as w from events)
select round(avg(v), 6) as v_mean, round(stddev_samp(v), 6) as v_deviation, round(min(v), 6) as v_min, round(max(v), 6) as v_max, round(avg(w), 6) as w_mean, round(stddev_samp(w), 6) as w_deviation, round(min(w), 6)::double as w_min, round(max(w), 6)::double as w_max from r""")
def q62_nan_stats(spark, sf):
    e = load(spark, sf, "events").select(F.when(c("event_id") % 10 == 0, float("nan")).otherwise(c("value")).alias("v"), F.when(c("event_type") == "click", 1.0).otherwise(0.0).alias("w"))
    m = M.nan_stats(e, ["v", "w"])
    return m.select(*[F.round(x, 6).alias(x) for x in m.columns])


@query()
def q63_text_scores(spark, sf):
    s = _spoken(spark, sf)
    scored = s.select("source", S.pair_score(S.meteor)("heard", "reference").alias("m"), S.pair_score(S.rouge_l)("heard", "reference").alias("r"))
    return scored.groupBy("source").agg(F.avg("m").alias("meteor"), F.avg("r").alias("rouge_l"))


@query()
def q64_corpus_bleu(spark, sf):
    return S.corpus_bleu(_spoken(spark, sf), "heard", "reference").select(F.round("bleu", 9).alias("bleu"), "prediction_length", "reference_length")


@query()
def q65_transcripts(spark, sf):
    d = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", N.udf(N.asr)("text").alias("asr"), N.udf(N.asr_chinese)("text").alias("asr_zh"), N.vietnamese(c("text")).alias("letters"))


@query(r"""
select doc_id, case when regexp_matches(text, '(?s)<answer>(.*?)</answer>') then trim(regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1), chr(32) || chr(9) || chr(10) || chr(13)) end as answer,
  split_part(text, chr(10), -1) as last_line, rtrim(text, '!') as calm, contains(text, 'Choices:') and contains(text, 'A. ') and contains(text, 'B. ') and contains(text, 'C. ') and contains(text, 'D. ') as has_choices from documents where text is not null""")
def q66_extracts(spark, sf):
    x = c("text")
    return load(spark, sf, "documents").filter("text is not null").select(
        "doc_id", T.tag(x, "answer", F.lit(None).cast("string")).alias("answer"), T.after_last(x, "\n").alias("last_line"), T.strip_exclamations(x).alias("calm"), T.formatted_choice_question(x).alias("has_choices")
    )


@query("""
select video_id, string_agg('*' || printf('%.3f', start) || '-' || printf('%.3f', start + duration), ' ' order by start, duration) as sections
from (select distinct video_id, start, duration from sdh_captions where start is not null and duration is not null and video_id is not null) group by 1""")
def q67_sections(spark, sf):
    d = load(spark, sf, "sdh_captions").na.drop(subset=["video_id", "start", "duration"]).select("video_id", "start", "duration").distinct()
    g = d.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "duration"))).alias("s"))
    return g.select("video_id", F.array_join(F.transform("s", lambda s: K.section(s.start, s.start + s.duration)), " ").alias("sections"))


@query(f"""
with q as (select qa_id, question, choices from {LAST_QA} where choices is not null and question is not null), e as (select qa_id, unnest(map_keys(choices)) as k, unnest(map_values(choices)) as v from q)
select q.qa_id, replace(any_value(question), chr(10), '') || ' Please choose the answer from the following options: ' || string_agg(k || '. ' || v, chr(10) order by k) || '.' as prompt from q join e using (qa_id) group by 1""")
def q68_choice_prompt(spark, sf):
    q = last_qa(spark, sf).filter("choices is not null and question is not null")
    return q.select("qa_id", P.multiple_choice_prompt(c("question"), c("choices")).alias("prompt"))


@query("""
select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 9) as running_mean from events""")
def q69_running_mean(spark, sf):
    r = M.running_mean(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return r.select("user_id", "event_id", F.round("running_mean", 9).alias("running_mean"))


@query(f"""
with q as (select length(answer) as n, ends_with(answer, '.') as done from {LAST_QA} where answer is not null)
select round(avg(n), 6) as mean_length, min(n) as min_length, max(n) as max_length, round(1 - avg(done::int), 6) as clipped_ratio, round(avg(case when done then n end), 6) as mean_ended, min(case when done then n end) as min_ended, max(case when done then n end) as max_ended from q""")
def q70_completion_stats(spark, sf):
    q = last_qa(spark, sf).filter("answer is not null").select(F.length("answer").cast("bigint").alias("n"), c("answer").endswith(".").alias("done"))
    m = M.completion_stats(q, "n", "done")
    return m.select(*[F.round(x, 6).alias(x) if x in ("mean_length", "clipped_ratio", "mean_ended") else c(x) for x in m.columns])


@query("""
select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by md5('7:' || event_id::varchar) desc, event_id) as n from events) where n <= 20""")
def q71_balanced_sample(spark, sf):
    return W.balanced_sample(load(spark, sf, "events"), "event_type", "event_id", 20).select("event_type", "event_id")


@query("""
with s as (select tar_file, count(*) as n from tar_mp4_mapping group by 1) select tar_file, n, (coalesce(sum(n) over (order by tar_file rows between unbounded preceding and 1 preceding), 0))::bigint as "offset" from s""")
def q72_file_offsets(spark, sf):
    return W.file_offsets(W.shard_sizes(load(spark, sf, "tar_mp4_mapping"), ["tar_file"]).withColumnRenamed("rows", "n"), "tar_file", "n")


@query(r"""
select count(*) as lines, count(distinct video_id) as files, count(*) filter (regexp_matches(text, '[\[{(]') and regexp_matches(text, '[\]})]')) as bracketed from sdh_captions""")
def q74_counters(spark, sf):
    return load(spark, sf, "sdh_captions").agg(F.count("*").alias("lines"), F.count_distinct("video_id").alias("files"), F.count_if(T.has_bracket_pair(c("text"))).alias("bracketed"))


@query(f"""
with w as (select len(list_filter(string_split(answer, ' '), lambda x: x <> '')) as n from (select distinct caption_id, answer from generated_caption where answer is not null))
select round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation from w""")
def q75_caption_lengths(spark, sf):
    g = load(spark, sf, "generated_caption").filter("answer is not null").select("caption_id", "answer").distinct()
    s = M.length_stats(g, F.size(F.filter(F.split("answer", " "), lambda w: w != "")))
    return s.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"""
select caption_id, {CLEAN.format('g.file_name')} as clip, tar_file from (select distinct caption_id, file_name from generated_caption where file_name is not null) g
join (select distinct tar_file, {CLEAN.format('mp4_name')} as clip from tar_mp4_mapping where mp4_name is not null) m on m.clip = {CLEAN.format('g.file_name')}""")
def q76_tar_of_clip(spark, sf):
    m = load(spark, sf, "tar_mp4_mapping").filter("mp4_name is not null").select("tar_file", K.clean_member(c("mp4_name")).alias("clip")).distinct()
    g = load(spark, sf, "generated_caption").filter("file_name is not null").select("caption_id", K.clean_member(c("file_name")).alias("clip"), "file_name").distinct().drop("file_name")
    return g.join(m, "clip").select("caption_id", "clip", "tar_file")


@query(r"""
with n as (select distinct l_suppkey as s, l_orderkey as k, greatest(length(l_orderkey::varchar), 6) as w from lineitem where l_suppkey is not null and l_orderkey is not null),
g as (select s, w, k, k - row_number() over (partition by s, w order by k) as i from n), r as (select s, w, lpad(min(k)::varchar, w::int, '0') as a, lpad(max(k)::varchar, w::int, '0') as b, count(*) as n from g group by s, w, i)
select 'p' || s::varchar || '-' || case when a = b then a else '{' || a || '..' || b || '}' end || '.tar' as pattern, n from r""")
def q77_shard_patterns_all(spark, sf):
    """The supplier is part of a name's prefix, and numbers of more than six digits keep all of them."""
    number = c("l_orderkey").cast("string")
    names = load(spark, sf, "lineitem").select(F.concat(F.lit("p"), c("l_suppkey").cast("string"), F.lit("-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.lit(".tar")).alias("name"))
    return W.shard_patterns(names)


@query()
def q78_normalise_all(spark, sf):
    """All English texts. No SQL: DuckDB's word boundary knows ASCII letters only."""
    d = spread(load(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").filter("text is not null and lang = 'en'")
    return d.select("doc_id", T.numbers_to_words(F.lower("text")).alias("words"), T.no_fillers(F.lower("text")).alias("spoken"))


@query(r"""
with t as (select list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') as w from (select distinct caption_id, answer from generated_caption where answer is not null)),
g as (select unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from t where len(w) >= 3)
select gram, count(*) as n from g group by 1""")
def q79_ngram_counts_all(spark, sf):
    t = load(spark, sf, "generated_caption").filter("answer is not null").select("caption_id", "answer").distinct()
    return t.select(F.explode(S.ngrams(T.tokens(F.lower("answer")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
