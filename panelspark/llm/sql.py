"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages
), d as (
  select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest,
    min(page_id) over (partition by sha256(body)) as first
  from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from d
"""

OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""

OP5 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle from w
), n as (select doc_id, count(*) as n from s group by doc_id
), met as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), link as materialized (
  select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
), way as (select a, b from link union select b, a from link
), reach as (select doc_id, doc_id as to_id from w union select reach.doc_id, way.b from reach join way on way.a = reach.to_id
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(reach.to_id) as component_id, w.doc_id = min(reach.to_id) as kept
from w left join n using (doc_id) join reach using (doc_id) group by w.doc_id, n.n
"""

OP6 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5(doc_id::varchar || '|17'), 1, 15))::bigint as key from documents
), t as (select source, sum(size)::bigint as s from d group by source
), w as (select *, [3, 1, 2][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight, row_number() over (order by source asc nulls last) as place from t
), c as (
  select *, 1.5::double * (select sum(s) from t)::double as budget,
    coalesce(sum(2 * s) over (order by 2 * s / weight, place rows between unbounded preceding and 1 preceding), 0)::double as caps_before,
    sum(weight) over (order by 2 * s / weight, place rows between current row and unbounded following)::double as weights_on from w
), f as (select *, 2 * s / weight <= (budget - caps_before) / weights_on as filled from c
), g as (
  select source, s, case when filled then (2 * s)::double
    else weight * (budget - coalesce((select sum(2 * s) from f where filled), 0)::double) / (select sum(weight) from f where not filled)::double end as target from f
), q as (
  select d.*, g.s as source_size, g.target, sum(size) over (partition by d.source order by key, doc_id rows unbounded preceding)::double as through
  from d join g on d.source is not distinct from g.source
), seq as (select doc_id, size, key, (through + source_size::double * copy) / target as finish from q, range(2) r(copy) where size > 0 and target > 0
), cut as (select doc_id, size, sum(size) over w <= least(1.5::double, 2) * (select sum(s) from t)::double as inside, row_number() over w as position
  from seq window w as (order by finish, key, doc_id rows unbounded preceding)
), taken as (select doc_id, sum(size)::bigint as taken, min(position) as first_position from cut where inside group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_position from q left join taken using (doc_id)
"""

OP10 = """
with d as (
  select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) || '|' || (row_number() over (partition by doc_id, text) - 1)::varchar || '|0'), 1, 15))::bigint as key,
    octet_length(encode(coalesce(text, '')))::bigint as bytes from documents
), node as (select level, key >> (60 - level) as prefix, sum(bytes)::bigint as shard_bytes, count(*) as shard_rows from d, range(61) r(level) group by 1, 2
), leaf as (
  select d.doc_id, d.bytes, d.key, min(level)::int as depth from d, range(61) r(level) join node using (level)
  where node.prefix = d.key >> (60 - level) and (shard_bytes <= 33554432 or level = 60) group by all
)
select doc_id, bytes, case when depth = 0 then '' else left(lpad(bin(key), 60, '0'), depth) end as shard, depth, shard_bytes, shard_rows, shard_bytes > 33554432 as oversized
from leaf join node on node.level = depth and node.prefix = key >> (60 - depth)
"""


#: The table of the crc32 comes from its polynomial; words meet over what one deletion leaves of them.
OP12 = r"""
with recursive crc as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by b) as t from range(256) r(b)
), run as (
  select doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as x from documents) where length(x) >= 7 group by all
), byte as (
  select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from run
), hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) as h
  from byte, crc
), word as materialized (
  select word, sum(times)::bigint as n from (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed)
  where length(word) >= 7 group by word having sum(times) >= 2
), less as materialized (
  select word, n, i, left(word, i::int) || substr(word, i::int + 2) as less from word, lateral (select unnest(range(length(word))) as i)
), near as materialized (
  select distinct a.word as a, a.n as n, b.word as b, b.n as m from less a join less b on a.less = b.less and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select word.word, word.n, less.word, less.n from less join word on word.word = less.less
  union select less.word, less.n, word.word, word.n from less join word on word.word = less.less
), best as (
  select a, count(*) as n_near, min(struct_pack(k := -m, b := b)) as best from near group by a
), formed as materialized (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.k >= 10 * n then best.b end as form, case when -best.k >= 10 * n then -best.k end as form_n
  from word left join best on a = word
), way as (
  select word, word as here, form as up from formed union all select way.word, way.up, formed.form from way join formed on formed.word = way.up
)
select word, n, n_near, form, form_n::bigint as form_n, here as root from formed join way using (word) where way.up is null
"""


OP13 = r"""
with term as materialized (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents
), whole as (select count(*) filter (len(t) > 0)::bigint as docs, sum(len(t))::bigint as terms from term
), tf as materialized (select row, doc_id, len(t)::bigint as n, x, count(*)::bigint as tf from (select row, doc_id, t, unnest(t) as x from term) group by all
), weight as (select x, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, whole group by x, docs
), asked as (
  select distinct item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as x
  from (select row_number() over () as item, * from benchmark)
), scored as (
  select item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::bigint as score
  from asked join weight using (x) join tf using (x), whole group by all
)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id) as int) as rank, doc_id, score from scored where score > 0 qualify rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op4_kdtree": OP4, "op5_minhash": OP5, "op6_mixing": OP6, "op10_sharding": OP10, "op12_variants": OP12, "op13_lexical": OP13}
