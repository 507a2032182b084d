"""Checking SQL of the training-data operators that SQL can express, written as the definitions read."""

from __future__ import annotations

SPELLING = r"""
with recursive bytes as (select list(c order by i) as t from (
    select i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) as c
    from (select unnest(range(256)) as i))),
runs as (select doc_id, run, count(*) as times from (select doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run
    from documents) group by all),
coded as (select doc_id, run, times, hex(encode(doc_id || ':' || run)) as x from runs),
hashed as (select run, times, doc_id, xor(4294967295, list_reduce(
      [('0x' || substr(x, 2 * i + 1, 2))::bigint for i in range(length(x) // 2)],
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint)) as h
    from coded, bytes where x is not null),
edited as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times
    from hashed union all select run, times from runs where doc_id is null),
words as (select word, sum(times)::bigint as n from edited where length(word) >= 5 group by word having sum(times) >= 3),
cut as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
shorter as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from cut),
near as (select a.word, b.word as other, b.n as other_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select s.word, w.word, w.n from shorter s join words w on s.rest = w.word
    union select w.word, s.word, s.n from shorter s join words w on s.rest = w.word),
best as (select word, count(*) as n_near, min({'less': -other_n, 'other': other}) as b from near group by word),
named as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.less >= 2 * w.n then b.other end as form,
      case when -b.less >= 2 * w.n then -b.less end as form_n from words w left join best using (word)),
chain as (select word, word as tip, 0 as depth from named
    union all select c.word, m.form, depth + 1 from chain c join named m on m.word = c.tip where m.form is not null)
select word, form, root, n, n_near, form_n::bigint as form_n from named join
    (select word, arg_max(tip, depth) as root from chain group by word) using (word)
"""

FILTER_AUDIT = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
parts as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from texts),
marked as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
masks as (select p.doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
      case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
      + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
      + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
      + case when min(p.doc_id) over (partition by t) < p.doc_id then 16 else 0 end as mask
    from parts p left join marked m on m.doc_id = p.doc_id),
f as (select i, chr(65 + i) as name from (select unnest(range(5))::int as i)),
orders as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.i, b.i, c.i, d.i, e.i] as fs
    from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select filter_order, s::int as step, 1 << fs[s] as own, coalesce(list_sum([1 << x for x in fs[1:s - 1]]), 0)::int as earlier
    from orders, (select unnest(range(1, 6)) as s)),
counts as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from masks group by all),
steps_of as (select part, filter_order, step, own, earlier, mask, n, good, toxic, mask & earlier <> 0 as gone, mask & own <> 0 as fails from counts, steps),
found as (select part, filter_order, step, own,
      coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (where not gone and fails), 0)::bigint as removed,
      coalesce(sum(n) filter (where gone and fails), 0)::bigint as redundant, coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
      coalesce(sum(good) filter (where not gone and fails), 0)::bigint as good_lost,
      coalesce(sum(toxic) filter (where not gone and fails), 0)::bigint as toxic_lost from steps_of group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint as shapley from found
"""

SHINGLE_JOIN = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingled as (select doc_id, list_sort(list_distinct(case when len(w) between 1 and 2 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s from words),
sets as (select s, min(doc_id) as rep, len(s) as n from shingled where len(s) > 0 group by s),
tokens as (select rep, n, unnest(s) as t from sets),
pairs as (select a.rep as x, b.rep as y from tokens a join tokens b
      on a.t = b.t and a.rep < b.rep and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links as (select x, y from pairs union all select y, x from pairs),
reach as (select rep, rep as tip from sets union select r.rep, l.y from reach r join links l on l.x = r.tip),
least_of as (select rep, min(tip) as component_id from reach group by rep)
select d.doc_id, len(d.s) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from shingled d left join sets using (s) left join least_of using (rep)
"""
