"""SQL that must give the same rows as the queries, where SQL can say it."""

from __future__ import annotations

P3 = r"""
with r as (select 'qa' as kind, qa_id as rec_id, thinking from (select *, row_number() over (partition by qa_id order by loaded_at desc) as rn from generated_qa) where rn = 1
  union all select 'caption', caption_id, thinking from (select *, row_number() over (partition by caption_id order by loaded_at desc) as rn from generated_caption) where rn = 1),
w as (select kind, rec_id, list_filter(regexp_extract_all(lower(thinking), '[\p{L}\p{N}]+'), lambda x: not regexp_full_match(x, '\p{N}+')) as w from r where thinking is not null),
g as (select kind, rec_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as gram from (select kind, rec_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
again as (select kind, rec_id, i from (select *, row_number() over (partition by kind, rec_id, gram order by i) as n from g) where n > 1),
marked as (select kind, rec_id, count(distinct i + k) as n from again, range(5) t(k) group by 1, 2)
select kind, rec_id from marked join w using (kind, rec_id) where n >= 0.4 * len(w)"""

BAGS = r"""
with r as (select 'qa' as kind, qa_id as id, question as t, split from (select *, row_number() over (partition by qa_id order by loaded_at desc) as rn from generated_qa) where rn = 1
  union all select 'caption', caption_id, answer, split from (select *, row_number() over (partition by caption_id order by loaded_at desc) as rn from generated_caption) where rn = 1),
w as (select kind, id, split, list_transform(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from r where t is not null),
s as (select kind, id, split, len(w) as n from w where len(w) > 0),
e as (select kind, id, word, count(*) as k from (select kind, id, unnest(w) as word from w) group by 1, 2, 3),
c as (select a.kind, a.id as a, b.id as b, sum(least(a.k, b.k)) as common from e a join e b on a.kind = b.kind and a.word = b.word and a.id < b.id group by 1, 2, 3)
"""

P4 = BAGS + """select c.kind, c.a as id_low, c.b as id_high from c join s x on x.kind = c.kind and x.id = c.a join s y on y.kind = c.kind and y.id = c.b
where common * 170 >= 70 * (x.n + y.n) and (x.split = 'train' and y.split in ('valid', 'test') or y.split = 'train' and x.split in ('valid', 'test'))"""

P5 = BAGS + """select c.kind, c.a as id_low, c.b as id_high from c join s x on x.kind = c.kind and x.id = c.a join s y on y.kind = c.kind and y.id = c.b where common * 170 >= 70 * (x.n + y.n)"""

ID = r"""nullif(regexp_extract(trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '^(?:.*[/=])?([A-Za-z0-9_-]{{11}})(?:$|[^A-Za-z0-9_-])', 1), '')"""

P6 = f"""
with recursive l as (select {ID.format('video_id')} as a, {ID.format('other_id')} as b from video_links where relation in ('reupload', 'mirror', 'excerpt')),
e as (select a, b from l where a is not null and b is not null union select b, a from l where a is not null and b is not null),
reach(node, other) as (select a, a from e union select r.node, e.b from reach r join e on e.a = r.other),
roots as (select node, min(other) as root from reach group by 1),
q as (select distinct split, case when video_id is not null then {ID.format('video_id')} else {ID.format('file_name')} end as id from generated_qa where split is not null)
select coalesce(root, id) as video_id from q left join roots on node = id where id is not null group by 1 having count(distinct split) > 1"""

SQL = {"p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6}
