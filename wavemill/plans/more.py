"""Queries of sources and sinks, prompts, extracts, signals, samples, joins and streams over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import keys as K
from ..functions import rewards as R
from ..functions import text as T
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import rows as W
from ..session import scratch
from ..sources import files, sinks, tar
from ..streaming import events as E
from . import pipelines as X
from .queries import LAST_QA, SQL, c, last_qa, load, query

BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"

SQL["q42_stream_resume"] = "select doc_id, source from documents"
SQL["q51_tar_round_trip"] = """
select lpad(((row_number() over (order by doc_id) - 1) // 512)::varchar, 6, '0') || '.tar' as archive, doc_id, text from documents where text is not null"""
TOKEN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[\p{Latin}\p{Cyrillic}\p{Greek}\p{Hangul}\p{Arabic}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}]"
SQL["q64_corpus_bleu"] = rf"""
with w as (select row_number() over () as id, answer, string_split(answer, ' ') as w from generated_caption where answer is not null),
s as (select id, answer as r, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when (i - 1) % 7 = 6 then '' when (i - 1) % 5 = 4 then 'noise' else w[i] end), lambda x: x <> ''), ' ') as h from w),
t as (select id, regexp_extract_all(h, '{TOKEN}') as a, regexp_extract_all(r, '{TOKEN}') as b from s),
g as (select id, n, array_to_string(a[i + 1 : i + n], chr(31)) as g, 1 as p, 0 as r from t, range(1, 5) k(n), range(0, 400) j(i) where i + n <= len(a)
  union all select id, n, array_to_string(b[i + 1 : i + n], chr(31)), 0, 1 from t, range(1, 5) k(n), range(0, 400) j(i) where i + n <= len(b)),
m as (select n, sum(least(p, r)) as m, sum(p) as t from (select id, n, g, sum(p) as p, sum(r) as r from g group by 1, 2, 3) group by 1),
l as (select sum(len(a))::bigint as prediction_length, sum(len(b))::bigint as reference_length from t)
select round(case when prediction_length >= reference_length then 1.0 else exp(1 - reference_length / prediction_length) end * exp((select avg(ln(m / t)) from m)), 9) as bleu, prediction_length, reference_length from l"""


# --- sources and sinks --------------------------------------------------------------------------------------------------


@query(r"select video_id, start, duration, regexp_replace(text, '\s', '', 'g') as letters from sdh_captions")
def q80_csv_round_trip(spark, sf):
    """Written and read as CSV with line ends within fields; white space is left out, as readers unify line ends."""
    out = scratch(spark)
    sinks.write_csv(load(spark, sf, "sdh_captions").select("video_id", "start", "duration", "text"), f"{out}/csv")
    back = files.csv(spark, f"{out}/csv", files.SDH, lines=True)
    return back.select("video_id", "start", "duration", F.regexp_replace("text", r"[ \t\n\x0b\f\r]", "").alias("letters"))


@query("select caption_id, video_id, thinking, answer from generated_caption")
def q81_json_lines_round_trip(spark, sf):
    out = scratch(spark)
    sinks.write_jsonl(load(spark, sf, "generated_caption").select("caption_id", "video_id", "thinking", "answer"), f"{out}/jsonl")
    return files.jsonl(spark, f"{out}/jsonl", "caption_id bigint, video_id string, thinking string, answer string")


@query("select video_id, start, duration, text from sdh_captions where text is not null")
def q82_subtitle_objects(spark, sf):
    """Objects that follow each other in files, with a list of subtitles or a single one, back as captions."""
    out = scratch(spark)
    one = F.struct(c("text").alias("t"), c("start").cast("string").alias("-start"), c("duration").cast("string").alias("-dur"))
    d = load(spark, sf, "sdh_captions")
    track = lambda x: F.to_json(F.struct(F.struct(c("video_id").alias("videoid")).alias("video"), F.array(F.struct(F.lit("en").alias("lang"), F.struct(F.struct(x.alias("text")).alias("transcript")).alias("subtitles"))).alias("captions")))
    rows = d.select(F.when(F.length("text") % 2 == 0, track(F.array(one))).otherwise(track(one)).alias("value"))
    rows.write.text(f"{out}/objects")
    return files.sdh_captions(files.concatenated_json(spark, f"{out}/objects"))


@query("""
with s as (select (row_number() over (order by doc_id) - 1) // 256 as s from documents) select lpad(s::varchar, 6, '0') || '.tar' as name, count(*) as n from s group by s""")
def q83_listing(spark, sf):
    """Archives of a folder by name, and the members of each by their headers."""
    out = scratch(spark)
    rows = W.sharded(load(spark, sf, "documents").select("doc_id"), ["doc_id"], 256)
    tar.write(rows.select("shard", c("doc_id").cast("string").alias("name"), F.lit("x").alias("content")), f"{out}/shards")
    per = tar.read(spark, f"{out}/shards").groupBy(T.base_name(c("archive")).alias("name")).agg(F.count("*").alias("n"))
    return files.listing(spark, f"{out}/shards").select("name").join(per, "name")


@query("select doc_id, source from documents where doc_id % 3 <> 0")
def q84_shards_and_status(spark, sf):
    """A folder per source; the rows that a status log doesn't name yet."""
    out = scratch(spark)
    d = load(spark, sf, "documents").select("doc_id", "source")
    sinks.write_shards(d, f"{out}/shards", ["source"])
    sinks.log_status(d.filter("doc_id % 3 = 0").select("doc_id"), f"{out}/log", "done")
    back = spark.read.parquet(f"{out}/shards").select("doc_id", c("source").cast("string").alias("source"))
    return J.not_done(back, spark.read.parquet(f"{out}/log"), ["doc_id"])


@query("""
select tar_file, lpad((row_number() over (order by tar_file) - 1)::varchar, 6, '0') || '.tar' as new_name from (select distinct tar_file from tar_mp4_mapping)""")
def q85_renumbered(spark, sf):
    return W.renumbered(load(spark, sf, "tar_mp4_mapping").select("tar_file").distinct(), ["tar_file"]).select("tar_file", "new_name")


@query("select doc_id, text from documents where text is not null")
def q86_rewritten_archives(spark, sf):
    """Archives written over themselves, and the members of a list read out of them by name."""
    out = scratch(spark)
    rows = W.sharded(load(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), ["doc_id"], 512)
    tar.write(rows.select("shard", F.concat(c("doc_id").cast("string"), F.lit(".bin")).alias("name"), c("text").alias("content")), f"{out}/shards")
    old = tar.read(spark, f"{out}/shards")
    tar.rewrite(old.select(F.regexp_extract("archive", r"(\d+)\.tar", 1).cast("int").alias("shard"), F.concat("stem", F.lit(".txt")).alias("name"), "content"), f"{out}/shards")
    wanted = rows.select(F.concat(F.lpad(c("shard").cast("string"), 6, "0"), F.lit(".tar")).alias("archive"), F.concat(c("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    got = tar.members_of(spark, f"{out}/shards", wanted)
    return got.select(F.substring_index("name", ".", 1).cast("bigint").alias("doc_id"), c("content").cast("string").alias("text"))


@query("select doc_id, lang from documents")
def q87_flushed_batches(spark, sf):
    """A stream whose batches each replace a folder of their own, and its metrics as one JSON file."""
    out = scratch(spark)
    load(spark, sf, "documents").select("doc_id", "lang").write.parquet(f"{out}/in")
    E.flush_batches(E.parquet_stream(spark, f"{out}/in", "doc_id bigint, lang string"), f"{out}/flushed", f"{out}/checkpoint")
    back = spark.read.parquet(f"{out}/flushed").select("doc_id", "lang")
    sinks.write_metrics(back.agg(F.count("*").alias("rows")), f"{out}/metrics")
    return back.crossJoin(F.broadcast(files.json_document(spark, f"{out}/metrics", "rows bigint"))).filter("rows > 0").select("doc_id", "lang")


# --- prompts and replies ------------------------------------------------------------------------------------------------


@query(f"""
select qa_id, 'Judge the text below. Reply with JSON holding the key valid.' || chr(10) || chr(10) || answer as judge, concat_ws(chr(10), '[Question] ' || question, '[Reference answer] ' || answer, '[Model answer] ' || thinking, 'Rate the model answer from 0 to 5. End with ''Rating: '' and the number.') as rubric,
  question || ' Reply in the tags <think>, <semantic_elements>, <answer>. Think at length. Think in about 80 words.' as suffixed, 'Transcription: ' || thinking || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' as spoken from {LAST_QA}""")
def q88_prompts(spark, sf):
    q, a, t = c("question"), c("answer"), c("thinking")
    return last_qa(spark, sf).select("qa_id", P.judge_prompt(a).alias("judge"), P.rubric_prompt(q, a, t).alias("rubric"), P.with_suffix(q, True, True, 80).alias("suffixed"), X.cascade_prompt(t, q).alias("spoken"))


@query(f"""
with q as (select qa_id, question, map_values(choices) as v from {LAST_QA} where choices is not null)
select qa_id, array_to_string(list_transform(range(1, len(v) + 1), lambda i: chr((64 + i)::int) || '. ' || v[i]), chr(10)) as listed, 'Question:' || chr(10) || question || chr(10) || 'Choices:' || chr(10) || array_to_string(v, ' ') as asked,
  list_extract(['What is heard?', 'Describe the sound.', 'Which sounds are there?'], (('0x' || substr(md5(qa_id::varchar), 1, 8))::bigint % 3 + 1)::int) as template from q""")
def q89_choices_and_templates(spark, sf):
    v = F.map_values("choices")
    q = last_qa(spark, sf).filter("choices is not null")
    return q.select("qa_id", P.lettered(v).alias("listed"), P.question_with_choices(c("question"), v).alias("asked"), W.choose(["What is heard?", "Describe the sound.", "Which sounds are there?"], c("qa_id")).alias("template"))


@query(rf"""
with t as (select doc_id, text as x, split_part(text, 'assistant' || chr(10), -1) as last from documents where text is not null)
select doc_id, trim(case when contains(last, '<answer>') then split_part(split_part(last, '<answer>', 2), '</answer>', 1) else last end, {BLANK}) as turn,
  case when contains(lower(x), 'answer:') then trim(regexp_extract(lower(x), 'answer:([^\n]*)', 1), {BLANK}) end as caption, case when contains(x, 'Answer: ') then split_part(x, 'Answer: ', 2) else x end as after,
  replace(replace(x, 'the sound of ', ''), 'sound of ', '') as bare from t""")
def q90_reply_extracts(spark, sf):
    x = c("text")
    d = load(spark, sf, "documents").filter("text is not null")
    bare = F.replace(F.replace(x, F.lit("the sound of "), F.lit("")), F.lit("sound of "), F.lit(""))
    whole = T.without_phrases(x, ["sound of ", "the sound of "])
    return d.select("doc_id", T.answer_of_turn(x).alias("turn"), T.caption_of_reply(x).alias("caption"), T.cascade_answer(x).alias("after"), F.when(whole == T.strip(bare), bare).alias("bare"))


@query(rf"""
with g as (select * from (select *, row_number() over (partition by caption_id order by loaded_at desc) as rn from generated_caption) where rn = 1)
select caption_id from g where len(list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w <> '')) <= 100 and length(answer) >= 10 and length(thinking) >= 10
  and not regexp_matches(thinking, 'original (caption|data|description|title)') and not regexp_matches(answer, 'original (caption|data|description|title)')""")
def q91_valid_captions(spark, sf):
    g = W.last_per_key(load(spark, sf, "generated_caption"), "caption_id", "loaded_at")
    return g.filter(P.valid_caption(c("answer"), c("thinking"))).select("caption_id")


@query(f"""
select qa_id from {LAST_QA} where length(question) >= 10 and length(thinking) >= 10 and length(answer) >= 3 and length(semantic_elements) >= 10
  and not regexp_matches(thinking, 'original (caption|data|description|title)') and not regexp_matches(answer, 'original (caption|data|description|title)') and not regexp_matches(semantic_elements, 'original (caption|data|description|title)')
  and list_sort(map_keys(choices)) = ['A', 'B', 'C', 'D'] and len(list_filter(map_values(choices), lambda v: v is null or trim(v) = '')) = 0""")
def q92_valid_choice_pairs(spark, sf):
    p = F.struct("question", "thinking", "semantic_elements", "answer", "choices")
    return last_qa(spark, sf).withColumn("p", p).filter(P.valid_pair(c("p"), semantic=True, choices=["A", "B", "C", "D"])).select("qa_id")


@query(f"""
select qa_id, greatest(0.0, least(1.0, length(answer) / 100.0))::double as share, ((case when answer = thinking then 0.5 else 0 end + case when left(answer, 3) = left(thinking, 3) then 0.25 else 0 end + case when length(answer) > 3 and length(thinking) > 3 and substr(answer, 4) = substr(thinking, 4) then 0.25 else 0 end) * 2)::double as total from {LAST_QA} where answer is not null and thinking is not null""")
def q93_clamped_rewards(spark, sf):
    """Values within bounds; sums of rewards in which a NaN counts as 0, or passes on."""
    q = last_qa(spark, sf).filter("answer is not null and thinking is not null")
    r = R.partial_accuracy(c("answer"), c("thinking"))
    total = R.weighted_total([r, F.lit(float("nan"))], [2.0, 1.0])
    passed = R.weighted_sum([r, F.lit(0.0)], [2.0, 1.0])
    return q.select("qa_id", W.clamp(F.length("answer") / 100.0, 0.0, 1.0).alias("share"), F.when(total == passed, total).alias("total"))


# --- keys and signals ---------------------------------------------------------------------------------------------------


@query("select distinct video_id, start_time as start, end_time as \"end\" from audio_out where video_id is not null and start_time is not null and end_time is not null")
def q94_downloaded_names(spark, sf):
    """Names of downloads, partial or not, taken apart."""
    a = load(spark, sf, "audio_out").na.drop(subset=["video_id", "start_time", "end_time"])
    name = F.concat("video_id", F.lit(" "), K.float_text(c("start_time")), F.lit("-"), K.float_text(c("end_time")), F.when(F.length("video_id") % 2 == 0, ".mp4").otherwise(".mp4.part"))
    return a.select(K.downloaded_name(name).alias("p")).select("p.*").distinct()


@query("""
with e as (select vec_id, embedding::double[] as e from embeddings)
select vec_id, round(list_sum(list_transform(range(0, len(e) // 2), lambda i: e[i * 2 + 1])), 5) as halved, (list_max(list_transform(e, lambda x: abs(x))) = 0 or len(e) <= 400)::boolean as silent, len(list_filter(e, lambda x: x > 1))::bigint as bright,
  round(list_sum(list_transform(range(0, len(e)), lambda i: (e[i + 1] + e[len(e) - i]) / 2)), 5) as mono, round(list_sum(list_transform(e, lambda x: x * 32768)), 2) as scaled, array_to_string(list_transform(range(8), lambda i: floor(i * (len(e) - 1) / 7)::int), ',') as picked from e""")
def q95_signals(spark, sf):
    x = c("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    picked = F.array_join(F.transform(A.even_indices(F.size(x)), lambda i: i.cast("string")), ",")
    return load(spark, sf, "embeddings").select(
        "vec_id", F.round(total(A.resample(x, 64, 32)), 5).alias("halved"), A.silent(x).alias("silent"), F.size(A.bright_frames(x)).cast("bigint").alias("bright"),
        F.round(total(A.mono(F.array(x, F.reverse(x)))), 5).alias("mono"), F.round(total(A.scaled(F.transform(x, lambda v: v.cast("double")))), 2).alias("scaled"), picked.alias("picked"),
    )


# --- joins, samples, windows --------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name from orders join customer on c_custkey = o_custkey")
def q96_total_join(spark, sf):
    """A join that must find every key of those orders that have one, and stem pairs of two kinds of member."""
    o, cust = load(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("c_custkey")), load(spark, sf, "customer").select("c_custkey", "c_name")
    known = o.join(cust.select("c_custkey"), "c_custkey", "left_semi")
    return J.total_join(known, cust, "c_custkey").select("o_orderkey", "c_name")


@query("select doc_id::varchar as stem, text as txt, source as src from documents where text is not null and source is not null")
def q97_stem_pairs(spark, sf):
    d = load(spark, sf, "documents")
    members = d.select(c("doc_id").cast("string").alias("stem"), F.lit(".txt").alias("ext"), c("text").alias("content")).unionByName(d.select(c("doc_id").cast("string").alias("stem"), F.lit(".src").alias("ext"), c("source").alias("content")))
    return J.stem_pairs(members, "stem", "ext", "content", [".txt", ".src"])


@query("""
select doc_id, case when row_number() over (order by md5('42:' || doc_id::varchar), doc_id) - 1 < ceil(round((select count(*) from documents) * 0.2, 6)) then 'valid' else 'train' end as split from documents""")
def q98_exact_share(spark, sf):
    return W.split_share_exact(load(spark, sf, "documents").select("doc_id"), "doc_id", 0.8).select("doc_id", "split")


@query("""
select video_id, doc_id from documents where coalesce(video_id, '') in (select coalesce(video_id, '') from documents group by video_id having count(*) >= 5)""")
def q99_groups_of_five(spark, sf):
    return W.with_least_rows(load(spark, sf, "documents").select("video_id", "doc_id"), "video_id", 5)


@query("""
select o_orderkey, n as position from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as n from orders) where n % 10 = 0""")
def q100_every_tenth(spark, sf):
    return W.every_nth(J.numbered(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"]), "position", 10).select("o_orderkey", "position")


@query("""
with t as (select user_id, -least((1 + value / 100) * (value - 50), greatest(least(1 + value / 100, 1.2), 0.8) * (value - 50)) as l, (event_type <> 'error')::int as m from events),
p as (select user_id, sum(l * m) as s, sum(m) as n from t group by 1)
select round(avg(s / greatest(n, 1.0)), 6) as grpo, round(sum(s) / greatest(sum(n), 1.0), 6) as bnpo, round(sum(s) / (count(*) * 128.0), 6) as dr from p""")
def q101_policy_loss(spark, sf):
    e = load(spark, sf, "events")
    ratio, gain, mask = 1 + c("value") / 100, c("value") - 50, c("event_type") != "error"
    loss = lambda kind: M.clipped_surrogate(e, ratio, gain, mask, kind=kind, sequence="user_id", longest=128).select(F.round("loss", 6).alias(kind))
    return loss("grpo").crossJoin(loss("bnpo")).crossJoin(loss("dr_grpo").withColumnRenamed("dr_grpo", "dr"))


@query("""
with b as (select user_id, event_id, (value < coalesce(min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 'infinity'::double))::int as better from events),
i as (select *, sum(better) over (partition by user_id order by event_id rows unbounded preceding) as i from b), k as (select *, sum(1 - better) over (partition by user_id, i order by event_id rows unbounded preceding) as bad from i)
select user_id, min(event_id) as stop_at from k where bad >= 5 group by 1""")
def q102_early_stop(spark, sf):
    return M.early_stop(load(spark, sf, "events"), ["user_id"], "event_id", "value", 5)


@query("""
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
s as (select user_id, event_id, value as smoothed, n from e where n = 1 union all select e.user_id, e.event_id, 0.5 * s.smoothed + 0.5 * e.value, e.n from s join e on e.user_id = s.user_id and e.n = s.n + 1)
select user_id, event_id, smoothed from s""")
def q103_smoothed_stream(spark, sf):
    """Smoothing with state of its own for each key, over a stream."""
    out = scratch(spark)
    load(spark, sf, "events").select("user_id", "event_id", "value").write.parquet(f"{out}/in")
    stream = E.parquet_stream(spark, f"{out}/in", "user_id bigint, event_id bigint, value double")
    E.run_available(E.smoothed_state(stream, "user_id", "event_id", "value"), f"{out}/out", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/out").select("user_id", "event_id", "smoothed")


@query(r"""
select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as letters from documents where lang = 'en' and regexp_full_match(text, '[\x00-\x7f]*')
union all select doc_id, null from documents where lang is null or text is null or lang <> 'en' or not regexp_full_match(text, '[\x00-\x7f]*')""")
def q104_letters_only(spark, sf):
    """Of all documents; compared where the two engines agree on what is white space and a letter, in English ASCII texts."""
    d = load(spark, sf, "documents")
    plain = F.coalesce((c("lang") == "en") & c("text").rlike(r"\A[\x00-\x7f]*\z"), F.lit(False))
    letters = T.letters_only(c("text"))
    return d.select("doc_id", F.when(plain, letters).alias("letters"))
