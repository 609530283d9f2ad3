"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where k in (from often)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k not in (from often)), '')) as kept_sha256
from keyed group by doc_id
"""

ORACLES["op10_ngram_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
  join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * i >= 90 * (m.n + n.n - i)),
reach as (select doc_id as a, doc_id as b from words union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(any_value(n), 0) as n_shingles, min(b) as component_id
from words w left join sizes s on s.doc_id = w.doc_id join reach r on r.a = w.doc_id group by w.doc_id
"""

ORACLES["op7_quality_rules"] = r"""
with base as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
win as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select rid, w, unnest(range(1, len(w) - 1)) as i from base where len(w) > 2)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from win) where c > 1),
rep as (select rid, count(distinct i + k) as n_repeat_words from twice, range(3) t(k) group by rid),
dup as (
  select rid, sum(c - 1) as n_dup_lines from (select rid, line, count(*) as c from (select rid, unnest(ls) as line from base) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by rid),
lines as (
  select rid, host, text, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as k
  from (select rid, host, text, unnest(ls) as line from base)),
keyed as (select *, len(k) - len(replace(k, ' ', '')) + 1 as n from lines where k <> ''),
often as (select host, k from keyed group by all having count(distinct text) > 20),
lost as (select rid, count(*) as n_removed_lines, sum(n) as lost from keyed x join often o on o.k = x.k and o.host is not distinct from x.host group by rid),
counts as (
  select doc_id, len(w) as n_words, coalesce(len(array_to_string(w, '')), 0) as word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_removed_lines, 0) as n_removed_lines, cast(len(w) - coalesce(lost, 0) as bigint) as n_left_words, lost is not null as touched
  from base left join rep using (rid) left join dup using (rid) left join lost using (rid))
select * exclude (touched), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  touched and (100 * n_left_words < 30 * n_words or n_left_words < 20) as depleted,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (touched and (100 * n_left_words < 30 * n_words or n_left_words < 20)) as kept
from counts
"""


def _nearest(centroids: str) -> str:
    return f"""select vec_id, c, dist from (
    select vec_id, c, dist, row_number() over (partition by vec_id order by dist, c) as place
    from (select vec_id, c, sum((x.q - m.q) * (x.q - m.q)) as dist from long_vectors x join {centroids} m on m.d = x.d group by vec_id, c)) where place = 1"""


def _rounds(n: int) -> str:
    return "".join(
        f"""
a{k} as materialized ({_nearest(f"c{k}")}),
m{k} as (select c, d, sum(q) as s, count(*) as n from a{k} join long_vectors using (vec_id) group by c, d),
c{k + 1} as materialized (select o.c, o.d, case when n is null then o.q else cast((s - ((s % n) + n) % n) // n as bigint) end as q from c{k} o left join m{k} m on m.c = o.c and m.d = o.d),"""
        for k in range(n)
    )


ORACLES["op11_centroid_clustering"] = f"""
with kept as (
  select vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
long_vectors as materialized (
  select vec_id, d, cast(floor(cast(x as double) * 256) as bigint) as q
  from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from kept)),
first as (select vec_id, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from kept order by c limit 40),
c0 as materialized (select c, d, q from first join long_vectors using (vec_id)),{_rounds(5)}
final as materialized ({_nearest("c5")}),
digests as (select c, sha256(string_agg(cast(q as varchar), ',' order by d)) as centroid_sha256 from c5 group by c)
select vec_id, cast(f.c as int) as cluster, cast(dist as bigint) as distance, cast(sum(dist) over (partition by f.c) as bigint) as cluster_inertia,
  cast(sum(dist) over () as bigint) as inertia, centroid_sha256
from final f join digests g on g.c = f.c
"""
