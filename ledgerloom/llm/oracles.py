"""DuckDB SQL for those training-data queries that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
with d as (select doc_id, {_ALNUM} as w from documents),
items as (select item_id, w, least(10, len(w)) as n from (select item_id, {_ALNUM} as w from benchmark) where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from items, unnest(range(1, len(w) - n + 2)) as t(i)),
ns as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from d cross join ns, unnest(range(1, len(w) - n + 2)) as t(i)),
h as (select doc_id, i, n, item_id from dw join iw using (n, g)),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
named as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""

OP7 = r"""
with r as (
  select page_id, url, html, case when md5(url) like '0d%' then '~' || substr(html, 2) else html end as hurt, encode(html) as octets from pages
),
w as (
  select page_id, head || html || tail as ours, head || hurt || tail as theirs, octet_length(encode(head || html || tail)) as size, md5(url) like '0d%' as damaged from (
    select *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::varchar || '>' || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(octets)::varchar || chr(13) || chr(10) || chr(13) || chr(10) as head, chr(13) || chr(10) || chr(13) || chr(10) as tail from r)
)
select page_id, row_number() over (order by page_id) - 1 as node, (sum(size) over (order by page_id) - size)::bigint as start, (sum(size) over (order by page_id))::bigint as "end",
  sha256(ours) as hash, sha256(theirs) as replica_hash, damaged from w
"""

OP8 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g from d, unnest(range(1, len(w) - 18)) as t(i)),
later as (select doc_id, i from g qualify row_number() over (partition by g order by doc_id, i) > 1),
cut as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, p, w[p] as word from d, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from words anti join cut using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (doc_id)
"""

OP9 = rf"""
with d as (select doc_id, text, {_WORDS} as w from documents),
ns as (select unnest([3, 4, 6, 10]) as n),
g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from d cross join ns, unnest(range(1, len(w) - n + 2)) as t(i)),
twice as (select doc_id, n, i from g qualify count(*) over (partition by doc_id, n, g) > 1),
inside as (select distinct doc_id, n, unnest(range(i, i + n)) as p from twice),
words as (select doc_id, p, length(w[p]) as size from d, unnest(range(1, len(w) + 1)) as t(p)),
chars as (select doc_id, sum(size) as word_chars from words group by doc_id),
cover as (select doc_id, count(*) filter (n = 3) as n3, sum(size) filter (n = 4) as c4, sum(size) filter (n = 6) as c6, sum(size) filter (n = 10) as c10 from inside join words using (doc_id, p) group by doc_id),
lines as (select doc_id, k, l from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as k from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
again as (select doc_id, count(*) as n, sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) as c from (select * from lines qualify row_number() over (partition by doc_id, l order by k) > 1) group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(again.n, 0)::bigint as n_dup_lines, coalesce(n3, 0)::bigint as n_repeat_words, coalesce(again.c, 0)::bigint as dup_line_chars, coalesce(c4, 0)::bigint as chars_4, coalesce(c6, 0)::bigint as chars_6, coalesce(c10, 0)::bigint as chars_10
  from d left join chars using (doc_id) left join cover using (doc_id) left join again using (doc_id)
),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and not (dup_line_chars > 0.30 * word_chars or n_symbols > 0.10 * word_chars or chars_4 > 0.40 * word_chars or chars_6 > 0.30 * word_chars or chars_10 > 0.25 * word_chars) as kept from f
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontam": OP5, "op7_warc": OP7, "op8_spans": OP8, "op9_quality": OP9}
