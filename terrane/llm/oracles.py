"""DuckDB SQL for the corpus operators whose results SQL can state."""

WARC = """
with p as (select page_id, encode(coalesce(html, '')) body from pages),
d as (select page_id, octet_length(body) payload_bytes, sha1(body) h, min(page_id) over (partition by sha1(body)) f from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((('0x' || substr(h, 1 + 5 * cast(i // 4 as int), 5))::bigint >> (15 - 5 * cast(i % 4 as int))) & 31 as int) + 1, 1)), 'string_agg', '') payload_digest,
  case when page_id = f then 'response' else 'revisit' end record_type,
  case when page_id = f then null else f end refers_to
from d
"""

#: crc32 over the bytes of a text: the table of the reflected polynomial 0xEDB88320, then a fold over the bytes.
SHARDING = """
with t as (select list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
b as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 size, hex(encode(coalesce(text, ''))) x,
  md5(concat_ws(':', '17', cast(doc_id as varchar))) h, coalesce('s' || source, 'n') s from documents),
c as (select b.doc_id, b.source, b.size, b.h, b.s,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, b.size - 1), lambda i: ('0x' || substr(b.x, 2 * i + 1, 2))::bigint)),
    lambda c, v: xor(c >> 8, t.tab[(xor(c, v) & 255) + 1])), 4294967295::bigint) crc
  from b, t),
r as (select *, row_number() over (partition by s order by h, doc_id, crc, size) - 1 r, count(*) over (partition by s) n from c),
p as (select *, row_number() over (order by (r + 0.5::double) / n, s) - 1 p, count(*) over () m from r)
select doc_id, source, cast(size as bigint) size, cast(crc as bigint) text_crc32, 'rows' law, cast(p * 8 // m as int) shard,
  cast(p - (cast(p * 8 // m as bigint) * m + 7) // 8 as bigint) slot, cast(null as int) grown_shard
from p
"""

#: All links between documents with a common shingle, then the least reachable id.
NEAR_COPIES = """
with recursive w as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) s from w),
n as (select doc_id, cast(len(s) as bigint) n from s),
e as (select doc_id, unnest(s) g from s),
i as (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from n union select r.doc_id, b from r join both_ways on a = r.c)
select n.doc_id, n.n n_shingles, min(c) component_id, n.doc_id = min(c) kept from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""

PHRASES = """
with w as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
v as (select doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') g from (select doc_id, w, unnest(range(0, len(w) - 19)) s from w)),
f as (select *, row_number() over (partition by g order by doc_id, s) k from v),
gone as (select distinct doc_id, s + i p from f, (select unnest(range(0, 20)) i) where k > 1),
k as (select doc_id, p, x from (select doc_id, unnest(w) x, unnest(range(0, len(w))) p from w) anti join gone using (doc_id, p)),
t as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from k group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) n_words, cast(len(w.w) - coalesce(t.n, 0) as bigint) n_removed, sha256(coalesce(t.t, '')) kept_sha256
from w left join t using (doc_id)
"""
