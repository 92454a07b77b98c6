"""DuckDB SQL for the queries that it can express; it compares everything with everything."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NN_DESCENT = """with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings),
sound as (select * from v where label is not null and len(e) > 0 and list_dot_product(e, e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id as x, b.vec_id as y from sound a join sound b
    on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach as (
  select vec_id, vec_id as other from v
  union
  select r.vec_id, l.y from reach r join links l on l.x = r.other),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
degree as (select x as vec_id, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from least left join degree using (vec_id)"""

REPEATS = f"""with w as (select doc_id, {_WORDS} as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50),
windows as (select doc_id, p, array_to_string(ws[p : p + 49], ' ') as t from places),
first as (select t, min(doc_id) as least from windows group by t),
lost as (select doc_id, p from windows join first using (t) where least < doc_id),
covered as (select distinct doc_id, unnest(range(p, p + 50)) as i from lost),
gone as (select doc_id, list(i) as places from covered group by doc_id)
select doc_id, len(ws) as n_words, coalesce(len(places), 0) as n_removed,
  sha256(array_to_string(case when places is null then ws else list_filter(ws,
    lambda x, i: not list_contains(places, i)) end, ' ')) as kept_sha256
from w left join gone using (doc_id)"""

CHOSEN_PATH = f"""with recursive w as (select doc_id, {_WORDS} as ws from documents),
pieces as (
  select doc_id, unnest(case when len(ws) >= 5 then
    list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
shingles as (select distinct doc_id, s from pieces),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from shared join sizes m on m.doc_id = x join sizes n on n.doc_id = y
  where c::double / (m.n + n.n - c) >= 0.8),
reach as (
  select doc_id, doc_id as other from w
  union
  select r.doc_id, l.y from reach r join links l on l.x = r.other),
least as (select doc_id, min(other) as class_id from reach group by doc_id),
degree as (select x as doc_id, count(*) as n_links from links group by x)
select doc_id, class_id, coalesce(n_links, 0) as n_links from least left join degree using (doc_id)"""

AUDIT = f"""with letters as (select unnest(range(5)) as i, unnest(['A', 'B', 'C', 'D', 'E']) as letter),
flags as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic
  from labels where doc_id is not null group by doc_id),
texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, {_WORDS} as ws from documents),
smallest as (select text, min(doc_id) as least from texts group by text),
masks as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(t.doc_id > least, false)::int as mask
  from texts t join smallest using (text) left join flags f on f.doc_id = t.doc_id),
cells as (
  select part, mask, count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic
  from masks group by all),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
    [a.i, b.i, c.i, d.i, e.i] as bits
  from letters a join letters b on a.i <> b.i join letters c on c.i not in (a.i, b.i)
  join letters d on d.i not in (a.i, b.i, c.i) join letters e on e.i not in (a.i, b.i, c.i, d.i)),
steps as (
  select filter_order, step, (1 << bits[step]) as own,
    list_sum(list_transform(bits[: step - 1], lambda x: 1 << x)) as earlier
  from orders, unnest(range(1, 6)) as s(step)),
found as (
  select part, filter_order, step, own,
    sum(case when (mask & (own | coalesce(earlier, 0))) = 0 then n else 0 end) as kept,
    sum(case when (mask & own) > 0 and (mask & coalesce(earlier, 0)) = 0 then n else 0 end) as removed,
    sum(case when (mask & own) > 0 and (mask & coalesce(earlier, 0)) > 0 then n else 0 end) as redundant,
    sum(case when mask = own then n else 0 end) as unique_fails,
    sum(case when (mask & own) > 0 and (mask & coalesce(earlier, 0)) = 0 then good else 0 end) as good_lost,
    sum(case when (mask & own) > 0 and (mask & coalesce(earlier, 0)) = 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from found"""

# The checksum of an id's digits: bytes and, after each, eight steps of one bit.
_CRC = """xor(list_reduce(
  list_concat([4294967295::bigint], flatten(list_transform(range(1, length(id) + 1),
    lambda i: [ascii(id[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)"""

PERIODIC = f"""with w as (select doc_id, doc_id::varchar as id, {_WORDS} as ws from documents),
seeds as (select doc_id, ws, len(ws) as n, {_CRC} as h from w),
places as (select *, case when n > 0 then (h // 10) % n else 0 end as a from seeds),
planted as (
  select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n),
    lambda i: ws[1 + (case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end)])
    else ws end as ws
  from places),
words as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i, len(ws) as n from planted),
matches as (
  select y.doc_id, y.i, y.i - x.i as q from words y join words x
    on x.doc_id = y.doc_id and x.word = y.word and x.i < y.i and 3 * (y.i - x.i) <= y.n),
diagonals as (
  select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as stretch from matches),
stretches as (
  select doc_id, min(i) - q as start, count(*) + q as length, q as period
  from diagonals group by doc_id, q, stretch having count(*) + q >= greatest(24, 3 * q)),
runs as (
  select * from stretches s where not exists (
    select 1 from stretches t where t.doc_id = s.doc_id and t.period < s.period
      and t.start <= s.start and t.start + t.length >= s.start + s.length)),
listed as (
  select doc_id, count(*) as n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs
  from runs group by doc_id),
best as (
  select * from runs
  qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i)
  group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period,
  1000 * b.length // b.period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
  sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join listed l using (doc_id) left join best b using (doc_id)
left join kept k using (doc_id)"""

ORACLE = {
    "op1_nn_descent": NN_DESCENT,
    "op3_count_min_repeats": REPEATS,
    "op9_chosen_path": CHOSEN_PATH,
    "op11_decision_diagrams": AUDIT,
    "op12_periodic_runs": PERIODIC,
}
