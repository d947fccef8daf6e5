"""DuckDB SQL for the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

ORACLE_SQL = {
    "op1_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, len(e) d, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) n from v),
links as (
  select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / a.n / b.n >= 0.98),
reach as (select vec_id a, vec_id b from u union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) component_id from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) n_links,
  coalesce(c.component_id, e.vec_id) component_id, coalesce(c.component_id, e.vec_id) = e.vec_id kept
from embeddings e left join c on c.a = e.vec_id
""",
    "op2_substring_dedup": r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) i from d where len(w) >= 20)),
ranked as (select doc_id, i, row_number() over (partition by g order by doc_id, i) r from win),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) i from ranked where r > 1),
word as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d),
kept as (
  select word.doc_id, string_agg(x, ' ' order by word.i) t from word
  where not exists (select 1 from gone where gone.doc_id = word.doc_id and gone.i = word.i) group by 1)
select d.doc_id, len(w)::bigint n_words,
  (select count(*) from gone where gone.doc_id = d.doc_id) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept on kept.doc_id = d.doc_id
""",
    "op6_line_dedup": r"""
with l as (
  select doc_id, coalesce(text, '') text, string_split(coalesce(text, ''), chr(10)) line from documents),
h as (select doc_id, text, unnest(line) x, generate_subscripts(line, 1) i from l),
r as (select doc_id, i, x,
  case when i > 1 then md5(concat(md5(lag(x) over o), md5(x))) end roll from h window o as (partition by doc_id order by i)),
b as (select doc_id, i, x, case when i > 3 and coalesce(lag(roll) over o < lag(roll, 2) over o and lag(roll) over o < roll, false)
  then 1 else 0 end begins from r window o as (partition by doc_id order by i)),
n as (select *, sum(begins) over (partition by doc_id order by i) c from b),
chunk as (select doc_id, c, string_agg(x, chr(10) order by i) t, count(*) lines from n group by 1, 2),
f as (select *, case when lines > 1 and regexp_matches(t, '[^ \t\n\v\f\r]') then
  row_number() over (partition by t, lines > 1 order by doc_id, c) else 1 end rn from chunk),
k as (select doc_id, sum(lines)::bigint n_lines, coalesce(sum(lines) filter (rn > 1), 0)::bigint n_removed,
  coalesce(string_agg(t, chr(10) order by c) filter (rn = 1), '') t from f group by 1)
select doc_id, n_lines, n_removed, sha256(t) kept_sha256 from k
""",
    "op7_url_filters": r"""
with p as (
  select page_id, lower(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) host,
    timestamp '2024-01-01' + to_hours((page_id % 8784)::int) fetched from pages),
hosts as (select distinct host from p where host <> ''),
domains as (select host d from hosts union
  select array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') from hosts),
e as (select d, md5(d) m, timestamp '2024-01-01' + to_days((('0x' || substr(md5(d), 2, 3))::int % 366)::int) as added
  from domains where md5(d) < '2'),
iv as (
  select d, added since, case when m >= '1' then added + to_days(30) end until from e
  union all select d, added + to_days(60), null from e where m >= '1'),
hit as (
  select page_id, arg_max(d, len(d)) entry from p join iv
  on (p.host = iv.d or p.host like '%.' || iv.d) and p.fetched >= iv.since and (iv.until is null or p.fetched < iv.until)
  group by 1)
select page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') fetched, entry is not null blocked, entry
from p left join hit using (page_id)
""",
    "op9_benchmark_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
g as (
  select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  from (select item_id, w, least(10, len(w)) n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) i from b where len(w) > 0)),
size as (select distinct n from g),
win as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, size where len(w) >= n)),
hit as (select doc_id, i, win.n, item_id from win join g on win.g = g.g and win.n = g.n),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from hit) group by 1),
it as (
  select doc_id, count(*) n_items, string_agg(s, ',' order by s) s
  from (select distinct doc_id, item_id::varchar s from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join it using (doc_id)
""",
    "op12_warc": r"""
with h as (select page_id, coalesce(html, '') p, sha1(coalesce(html, '')) x from pages),
d as (
  select page_id, strlen(p) payload_bytes, p, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', x[5 * i // 4 + 1]) - 1) * 16
      + strpos('0123456789abcdef', x[5 * i // 4 + 2]) - 1) >> (3 - 5 * i % 4)) & 31)::int, 1)), '') payload_digest from h),
m as (select *, max(page_id) over (partition by p) chosen from d)
select page_id, payload_bytes, payload_digest, case when page_id = chosen then 'response' else 'revisit' end record_type,
  case when page_id <> chosen then chosen end refers_to from m
""",
    "op13_collocations": r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) x from documents),
w as (select lang, regexp_extract_all(x, '[^\x20\x09]+') w from p),
total as (select lang, sum(len(w))::bigint n from w group by 1),
f as (
  select lang, array_to_string(w[i:i + m - 1], ' ') phrase, m, count(*) f
  from (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) i
    from (select lang, w, unnest(generate_series(1, 5)) m from w) where len(w) >= m)
  group by 1, 2, 3 having count(*) >= 100),
c as (select lang, phrase, m, f a, string_split(phrase, ' ') w from f where m > 1),
cut as (
  select lang, phrase, m, a, k, array_to_string(w[:k], ' ') p1, array_to_string(w[k + 1:], ' ') p2
  from (select *, unnest(generate_series(1, m - 1)) k from c)),
s as (
  select cut.lang, cut.phrase, cut.m, a, k, x.f l, y.f r, n, (1000::hugeint * a * n // (x.f::hugeint * y.f))::bigint score
  from cut join f x on x.lang = cut.lang and x.phrase = p1 join f y on y.lang = cut.lang and y.phrase = p2 join total on total.lang = cut.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, array_to_string(w[i:i + g - 1], ' ') phrase, a
  from (select *, unnest(generate_series(1, m - g + 1)) i from (select *, unnest(generate_series(2, m - 1)) g from c where m > 2))),
longer as (select lang, phrase, max(a) longer from inner_ group by 1, 2),
kept as (select b.* from b left join longer using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score
from kept qualify "rank" <= 2000
""",
}
