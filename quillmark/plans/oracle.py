"""DuckDB SQL for the rows of the originality queries, composed of shared common table expressions."""

from __future__ import annotations

from quillmark.params import (
    ACADEMIC_DOMAINS,
    BANK,
    BLOCKED_SUFFIXES,
    CONNECTORS,
    COVER_MARKERS,
    EXCERPT,
    GENERIC_PHRASES,
    HEADINGS,
    INTERNAL,
    INTERNAL_QUERY,
    LOW_VALUE_MARKERS,
    PERSONAL_MARKERS,
    PHRASE_SIZES,
    STOP_WORDS,
    WEB,
    WEB_QUERY,
    Scoring,
    Windowing,
)

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LETTERS = "A-Za-záéíóúñüÁÉÍÓÚÑÜ0-9"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalized(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def half_even(n: str, d: str) -> str:
    return f"(({n}) // ({d}) + case when 2 * (({n}) % ({d})) > ({d}) or (2 * (({n}) % ({d})) = ({d}) and (({n}) // ({d})) % 2 = 1) then 1 else 0 end)"


def percent(h: str) -> str:
    return f"(({h})::decimal(7,0) / 100)::decimal(5,2)"


def strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TOKENS = rf"""
pc as (select doc_id, unnest(p) x, generate_subscripts(p, 1) i
  from (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') p from documents)),
po as (select doc_id, i, x, sum(length(x)) over (partition by doc_id order by i) e from pc),
tk as (select doc_id, row_number() over (partition by doc_id order by i) - 1 k, x token, (e - length(x))::bigint s, e::bigint e
  from po where regexp_full_match(x, '[{LETTERS}]+'))"""


def fragments(name: str, w: Windowing) -> str:
    return f"""
{name}_w as (
  select doc_id, w, min(s) s, max(e) e, count(*) n
  from (select doc_id, s, e, unnest(generate_series(greatest(0, (k - {w.size} + {w.step}) // {w.step})::bigint, (k // {w.step})::bigint)) w from tk)
  group by 1, 2 having count(*) >= {w.least}),
{name} as (
  select doc_id, w chunk_ix, s start_offset, e end_offset, n word_count, {normalized('substr(text, s + 1, e - s)')} t
  from {name}_w join documents using (doc_id))"""


def shingled(name: str, rows: str, key: str, size: str) -> str:
    return f"""
{name}_a as (select {key}, list_distinct(case when len(v) < 4 then v else
  list_transform(generate_series(1, len(v) - 3), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2] || ' ' || v[i + 3]) end) sh
  from (select {key}, list_filter(string_split(t, ' '), lambda x: x <> '') v from {rows})),
{name} as (select {key}, len(sh) {size}, unnest(sh) sh from {name}_a)"""


def bonus(s: Scoring) -> str:
    out = "0"
    for size, points in reversed(list(zip(PHRASE_SIZES, s.bonus, strict=True))):
        phrases = f"list_transform(generate_series(0, greatest(len(v) - {size}, 0) // 5), lambda i: array_to_string(v[i * 5 + 1:i * 5 + {size}], ' '))"
        out = f"case when len(list_filter({phrases}, lambda x: contains(ct, x))) > 0 then {points} else {out} end"
    return f"case when len(v) < 12 then 0 else {out} end"


def scored(pairs: str, s: Scoring) -> str:
    """CTEs ``sc`` from pairs (k, c, p, qt, ct)."""
    d = "(c * (c + p))"
    n = f"least(k * ({s.coverage} * (c + p) + {2 * s.dice} * c) + z * {d}, 100 * {d})"
    return f"""
sv as (select *, string_split(qt, ' ') v from {pairs}),
sb as (select *, ({bonus(s)})::bigint z from sv),
sn as (select *, {n} n, {d} d from sb),
sc as (select *, {half_even('100 * n', 'd')} h from sn where n >= {s.threshold} * d)"""


INTERNAL_PAIRS = f"""{TOKENS}, {fragments('qi', INTERNAL_QUERY)}, {fragments('bk', BANK)},
{shingled('qs', 'qi', 'doc_id, chunk_ix', 'c')}, {shingled('bs', 'bk', 'doc_id, chunk_ix', 'p')},
pr as (select q.doc_id, q.chunk_ix, b.doc_id cand_doc, b.chunk_ix cand_chunk, c, p, count(*) k
  from qs q join bs b on q.sh = b.sh and q.doc_id <> b.doc_id group by all),
pt as (select pr.*, qi.start_offset, qi.end_offset, qi.t qt, bk.t ct from pr join qi using (doc_id, chunk_ix)
  join bk on bk.doc_id = cand_doc and bk.chunk_ix = cand_chunk),
{scored('pt', INTERNAL)}"""


def best(order: str) -> str:
    return f"""
be as (select * from sc qualify row_number() over (partition by doc_id, chunk_ix order by h desc, {order}) = 1),
tp as (select *, row_number() over (partition by doc_id order by h desc, start_offset) rank from be qualify rank <= 35)"""


INTERNAL_BEST = INTERNAL_PAIRS + "," + best("cand_doc desc, cand_chunk desc")

HIDDEN = "script style noscript svg iframe nav footer header".split()


def visible(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '(?s)<!--.*?-->', ' ', 'g')"
    for tag in HIDDEN:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    return squeeze(entities(f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"))


def entities(x: str) -> str:
    for name, code in (("&nbsp;", 160), ("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&#39;", 39), ("&lt;", 60), ("&gt;", 62), ("&amp;", 38)):
        x = f"replace({x}, '{name}', chr({code}))"
    return x


DOMAIN = "replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"
BLOCKED = rf"regexp_matches(string_split(lower({{url}}), '?')[1], '\.({'|'.join(BLOCKED_SUFFIXES)})$')"
PAGES = f"""
pg as (select page_id, url, {DOMAIN} domain, {squeeze(entities("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"))} found,
  {visible('html')} pt from pages where not {BLOCKED.format(url='url')}),
pp as (select page_id, domain, substr(coalesce(nullif(found, ''), nullif(domain, ''), url), 1, 300) title, pt, {normalized('pt')} t
  from pg where length(pt) >= 500)"""
WEB_PAIRS = f"""{TOKENS}, {fragments('qi', WEB_QUERY)}, {PAGES},
{shingled('qs', 'qi', 'doc_id, chunk_ix', 'c')}, {shingled('bs', 'pp', 'page_id', 'p')},
pr as (select doc_id, chunk_ix, page_id, c, p, count(*) k from qs join bs using (sh) group by all),
pt as (select pr.*, qi.start_offset, qi.end_offset, qi.t qt, pp.t ct from pr join qi using (doc_id, chunk_ix) join pp using (page_id)),
{scored('pt', WEB)}"""
WEB_BEST = WEB_PAIRS + "," + best("page_id")


def renamed(ctes: str, prefix: str) -> str:
    """The CTEs as one nested query of the top matches, so that both kinds fit into one statement."""
    return f"{prefix} as (with {ctes} select * from tp)"


RANGES = f"""{renamed(INTERNAL_BEST, 'ti')}, {renamed(WEB_BEST, 'tw')},
rg as (select doc_id, start_offset, end_offset from ti union all select doc_id, start_offset, end_offset from tw)"""


def merged(rows: str, key: str = "doc_id") -> str:
    return f"""
mf as (select *, case when start_offset > coalesce(max(end_offset) over (partition by {key} order by start_offset, end_offset
  rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end fresh from {rows}),
mi as (select *, sum(fresh) over (partition by {key} order by start_offset, end_offset rows unbounded preceding) island from mf),
mg as (select {key}, min(start_offset) start_offset, max(end_offset) end_offset from mi group by {key}, island)"""


def matched(rows: str) -> str:
    """CTE ``mp``: (doc_id, h), covered hundredths of a percent."""
    return f"""{merged(rows)},
mc as (select doc_id, sum(end_offset - start_offset)::bigint chars from mg group by 1),
mp as (select doc_id, least({half_even('10000 * coalesce(chars, 0)', 'greatest(length(text), 1)')}, 10000) h from documents left join mc using (doc_id))"""


def risk(s: str, a: str) -> str:
    return (
        f"case when {s} >= 5000 or {a} >= 8000 then 'CRITICAL' when {s} >= 3000 or {a} >= 6000 then 'HIGH' "
        f"when {s} >= 1500 or {a} >= 3500 then 'MEDIUM' else 'LOW' end"
    )


def line_breaks(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


PAGED = "replace(text, chr(10), chr(10) || chr(10))"
#: Non-blank paragraphs (lines) of the stripped text with their number and, without blank ends, place.
PARAGRAPHS = rf"""
tx as (select doc_id, {PAGED} tt from documents),
pq as (select doc_id, regexp_replace(tt, '\n{SPACE}*\n', chr(1), 'g') m, tt from tx),
ps as (select doc_id, string_split(m, chr(1)) p, regexp_extract_all(tt, '\n{SPACE}*\n') g from pq),
pu as (select doc_id, unnest(p) raw, generate_subscripts(p, 1) i, g from ps),
pv as (select doc_id, i - 1 ix, raw, sum(length(raw) + coalesce(length(g[i - 1]), 0)) over (partition by doc_id order by i) - length(raw) base from pu),
pa as (select doc_id, ix, {strip('raw')} paragraph,
  (base + length(raw) - length(regexp_replace(raw, '^{SPACE}+', '')))::bigint start_offset from pv),
pf as (select *, start_offset + length(paragraph) end_offset from pa where length(paragraph) >= 120)"""


def count_words(x: str) -> str:
    pieces = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({pieces}, lambda y: regexp_full_match(y, '[a-záéíóúñü]{{3,}}'))"


def lexicon(phrases) -> str:
    return " + ".join(f"(length(lp) - length(replace(lp, '{p}', ''))) // {len(p)}" for p in phrases)


FEATURES = rf"""{PARAGRAPHS},
fa as (select *, lower(paragraph) lp, {count_words('paragraph')} wl,
  list_filter(string_split(regexp_replace(paragraph, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')} <> '') sl from pf),
fb as (select *, list_filter(list_transform(sl, lambda x: len({count_words('x')})), lambda y: y > 0) xl from fa),
ft as (select *, len(wl)::bigint w, len(list_distinct(wl))::bigint u, len(sl)::bigint sentences, len(xl)::bigint n,
  coalesce(list_sum(xl), 0)::bigint s, coalesce(list_sum(list_transform(xl, lambda x: x * x)), 0)::bigint q,
  (length(paragraph) - length(regexp_replace(paragraph, '[.,;:]', '', 'g')))::bigint punctuation, length(paragraph)::bigint chars,
  ({lexicon(CONNECTORS)})::bigint connectors, ({lexicon(GENERIC_PHRASES)})::bigint generic, ({lexicon(PERSONAL_MARKERS)})::bigint personal from fb)"""
SCORES = f"""{FEATURES},
so as (select *, case when w < 45 or sentences < 2 or n = 0 then 0 else greatest(0, least(95,
  case when n*q - s*s <= 25*n*n then 20 when n*q - s*s <= 64*n*n then 14 when n*q - s*s <= 144*n*n then 8 else 0 end
  + case when s between 16*n and 28*n then 13 when s between 12*n and 34*n then 7 else 0 end
  + case when 100*u between 42*w and 66*w then 14 when 100*u between 35*w and 75*w then 7 else 0 end
  + case when 1000*connectors >= 30*w then 18 when 1000*connectors >= 15*w then 10 else 0 end
  + case when 1000*generic >= 20*w then 18 when 1000*generic >= 10*w then 10 else 0 end
  + case when 1000*punctuation between 18*chars and 65*chars then 8 else 0 end
  + case when 100*(w-u) >= 16*w then 8 when 100*(w-u) >= 10*w then 4 else 0 end
  + case when personal > 0 then -18 else 0 end)) end::bigint score from ft)"""
PROBABILITY = f"""
sa as (select doc_id, sum(score * chars)::bigint a, sum(chars)::bigint b from so group by 1),
pb as (select doc_id, {half_even('100 * coalesce(a, 0)', 'coalesce(b, 1)')} ai from documents left join sa using (doc_id))"""
STYLE_TOP = "sf as (select *, row_number() over (partition by doc_id order by score desc, start_offset) rank from so where score >= 38 qualify rank <= 20)"


def low_value(p: str) -> str:
    heading = " or ".join(f"starts_with(lower({p}), '{h}' || chr(10))" for h in HEADINGS)
    lines = rf"list_filter(list_transform(string_split(regexp_replace({p}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""(length({p}) < 40 or {heading} or (len({lines}) >= 5 and 4 * len(list_filter({lines}, lambda x: length(x) <= 65)) > 3 * len({lines})
      and len(list_filter({lines}, lambda x: contains(x, '...') or regexp_matches(x, '{SPACE}\\p{{Nd}}+$'))) >= 2))"""


def cover(p: str, ix: str) -> str:
    markers = " + ".join(f"contains(lower({p}), '{m}')::int" for m in COVER_MARKERS)
    return f"({ix} <= 3 and {markers} >= 3 and length({p}) < 1200)"


#: Paragraphs of the cleaned text; it has no stop words here.
CLEAN_PARAGRAPHS = rf"""
cl as (select doc_id, {line_breaks(PAGED)} c from documents),
cs as (select doc_id, string_split(regexp_replace(c, '\n{SPACE}*\n', chr(1), 'g'), chr(1)) p from cl),
cu as (select doc_id, {strip('x')} paragraph, ix from (select doc_id, unnest(p) x, generate_subscripts(p, 1) - 1 ix from cs)),
cp as (select * from cu where paragraph <> '')"""
FILTERED = f"""{CLEAN_PARAGRAPHS},
cf as (select *, case when {cover('paragraph', 'ix')} then 'portada' when {low_value('paragraph')} then 'sección no académica' end label from cp),
fl as (select doc_id, string_agg(paragraph, chr(10) || chr(10) order by ix) filter (label is null) content,
  string_agg(label, '|' order by ix) filter (label is not null) excluded,
  coalesce(list(label order by ix) filter (label is not null), []) labels from cf group by 1)"""


def first_spellings(x: str) -> str:
    return f"list_filter({x}, lambda y, i: trim(lower(y)) <> '' and list_position(list_transform({x}, lambda z: trim(lower(z))), trim(lower(y))) = i)"


LISTED = " or ".join(f"contains(substr(lower(p), 1, 90), '{m}')" for m in LOW_VALUE_MARKERS)
PHRASES = rf"""
ha as (select doc_id, {squeeze('x')} p, i from (select doc_id, unnest(l) x, generate_subscripts(l, 1) i
  from (select doc_id, string_split(regexp_replace({PAGED}, '\n{SPACE}*\n', chr(1), 'g'), chr(1)) l from documents))),
hb as (select *, list_filter(string_split(regexp_replace(p, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)),
  lambda s: len(string_split(s, ' ')) between 10 and 34) sl, string_split(p, ' ') wl from ha where length(p) >= 160 and not ({LISTED})),
hc as (select *, list_max(list_transform(sl, lambda s: length(s))) m from hb),
hd as (select doc_id, i, substr(coalesce(list_filter(sl, lambda s: length(s) = m)[1],
  case when len(wl) >= 18 then array_to_string(wl[1:30], ' ') else '' end), 1, 260) b from hc),
he as (select doc_id, list(b order by i) b from hd group by 1),
hf as (select doc_id, {first_spellings('b')} phrases from he)"""
QUERY_LISTS = f"""{PHRASES},
hg as (select doc_id, phrases[1:8] p from hf),
hh as (select doc_id, list_concat(list_concat(list_transform(p, lambda x: '"' || x || '"'), p[1:4]),
  list_concat(flatten(list_transform(p[1:3], lambda x: list_transform({strings(ACADEMIC_DOMAINS)}, lambda d: '"' || x || '" site:' || d))),
  list_transform(p[1:3], lambda x: '"' || x || '" filetype:pdf'))) q from hg),
hi as (select doc_id, {first_spellings('q')} queries from hh)"""

HIGHLIGHTS = f"""{RANGES}, {SCORES}, {STYLE_TOP},
fi as (select doc_id, start_offset, 0 priority, end_offset, 'SIMILARITY' finding_type from rg
  union all select doc_id, start_offset, 1, end_offset, 'AI_GENERATED' from sf),
fo as (select fi.*, length(text) len, row_number() over (partition by doc_id order by start_offset, priority, fi.end_offset, finding_type) r
  from fi join documents using (doc_id) where start_offset < fi.end_offset and start_offset < length(text)),
fold as (
  select doc_id, 0::bigint r, 0::bigint cur, 0::bigint a, 0::bigint b, null::varchar finding_type, false took from (select distinct doc_id from fo)
  union all
  select f.doc_id, f.r, case when f.start_offset < l.cur then l.cur else least(f.end_offset, f.len) end, f.start_offset, least(f.end_offset, f.len),
    f.finding_type, f.start_offset >= l.cur from fold l join fo f on f.doc_id = l.doc_id and f.r = l.r + 1),
kept as (select doc_id, a, b, finding_type from fold where took),
gaps as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) a, a b from kept
  union all select documents.doc_id, coalesce(max(kept.b), 0), any_value(length(text)) from documents left join kept using (doc_id) group by 1),
seg as (select doc_id, a, b, finding_type from kept union all select doc_id, a, b, null from gaps where a < b)"""

#: All pages with their words; the parts that each query asks for, its bounds, and the pages that hold all parts.
SEARCHED = rf"""{QUERY_LISTS},
sa as (select doc_id, unnest(queries) query, generate_subscripts(queries, 1) - 1 query_ix from hi),
sp as (select query, string_split(trim(substr({squeeze('query')}, 1, 380)), '"') p from (select distinct query from sa)),
sb as (select query, list_filter(p, lambda x, i: i % 2 = 0) quoted, array_to_string(list_filter(p, lambda x, i: i % 2 = 1), ' ') plain from sp),
sc as (select query, lower(regexp_extract(plain, '(?:^| )site:(\S+)', 1)) site, lower(regexp_extract(plain, '(?:^| )filetype:(\S+)', 1)) kind,
  list_sort(list_distinct(list_filter(list_concat(list_transform(quoted, lambda x: {normalized('x')}),
    string_split({normalized("regexp_replace(plain, '(?:^| )(?:site|filetype):\\S+', ' ', 'g')")}, ' ')), lambda x: x <> ''))) parts from sb),
sd as (select distinct parts from sc where len(parts) > 0),
se as (select parts, unnest(list_distinct(string_split(array_to_string(parts, ' '), ' '))) w from sd),
sg as (select page_id, url, {DOMAIN} domain, lower(string_split(url, '?')[1]) path, {normalized(visible('html'))} t from pages),
sh as (select page_id, w, count(*) n from (select page_id, unnest(string_split(t, ' ')) w from sg) group by 1, 2),
si as (select parts, page_id, sum(n)::bigint score from se join sh using (w) group by 1, 2
  having count(*) = len(list_distinct(string_split(array_to_string(parts, ' '), ' ')))),
sj as (select si.*, url, domain, path from si join sg using (page_id)
  where len(list_filter(parts, lambda x: not contains(' ' || t || ' ', ' ' || x || ' '))) = 0),
sr as (select query, page_id, url, score, row_number() over (partition by query order by score desc, page_id) as rank
  from sc join sj using (parts) where (site = '' or domain = site or ends_with(domain, '.' || site)) and (kind = '' or ends_with(path, '.' || kind))
  qualify rank <= 5)"""
#: The pages that are read for each document.
COLLECTED = f"""{SEARCHED}, {PAGES},
sk as (select doc_id, query_ix, rank, page_id, url from sa join sr using (query) where {DOMAIN} <> ''
  qualify row_number() over (partition by doc_id, url order by query_ix, rank) = 1),
sl as (select sk.* from sk semi join pp using (page_id) qualify row_number() over (partition by doc_id order by query_ix, rank) <= 16)"""

#: An analysis: the texts asked about are filtered ones (``ac``), the bank's are whole.
ASKED = "documents as (select * from ac)"
ASKED_QUERY = f"qi as (with {ASKED}, {TOKENS}, {fragments('qi', INTERNAL_QUERY)} select * from qi)"
ANALYSIS = f"""{FILTERED},
ac as (select doc_id, coalesce(nullif(content, ''), {PAGED}) as text from documents left join fl using (doc_id)),
{renamed(INTERNAL_BEST.replace(fragments('qi', INTERNAL_QUERY), ASKED_QUERY), 'ti')}, {renamed(f'{ASKED}, {WEB_BEST}', 'tw')},
rg as (select doc_id, start_offset, end_offset from ti union all select doc_id, start_offset, end_offset from tw),
hi as (with {ASKED}, {matched('ti')} select * from mp), hw as (with {ASKED}, {matched('tw')} select * from mp),
ht as (with {ASKED}, {matched('rg')} select * from mp),
ha as (with {ASKED}, {SCORES.replace(PAGED, 'text')}, {PROBABILITY} select * from pb)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes.strip()}\n{select}"


FRAGMENT = "select doc_id, chunk_ix, start_offset, end_offset, word_count, sha256(t) content_hash from"
OWNED = """d as (select o_orderkey doc_id, o_custkey owner_id, c_nationkey institution_id, o_orderdate created_at
  from orders join customer on c_custkey = o_custkey)"""


def planted(markup: tuple[tuple[str, str], ...]) -> str:
    """SQL for the text of pages with a word put in, for which the text that the markup shows then stands."""
    shown = strings(t.replace("'", "''") for _, t in markup)
    page = visible("replace(html, '</article>', ' zzplanted </article>') || '<p>end'")
    return f"select page_id, replace({page}, 'zzplanted', {shown}[page_id % {len(markup)} + 1]) as text from pages"


ORACLE_SQL: dict[str, str] = {
    "search_results": with_(SEARCHED, "select query, rank, page_id, score from sr"),
    "web_candidates": with_(COLLECTED, "select doc_id, query_ix, rank, page_id, url from sl"),
    "searched_percent": with_(
        f"""wd as (with {COLLECTED} select doc_id, page_id, query_ix * 100 + rank as place from sl),
{TOKENS}, {fragments('qi', WEB_QUERY)}, {PAGES}, {shingled('qs', 'qi', 'doc_id, chunk_ix', 'c')}, {shingled('bs', 'pp', 'page_id', 'p')},
pr as (select qs.doc_id, chunk_ix, bs.page_id, place, c, p, count(*) k from qs join wd on wd.doc_id = qs.doc_id
  join bs on bs.page_id = wd.page_id and bs.sh = qs.sh group by all),
pt as (select pr.*, qi.start_offset, qi.end_offset, qi.t qt, pp.t ct from pr join qi using (doc_id, chunk_ix) join pp using (page_id)),
{scored('pt', WEB)}, {best('place')}, {matched('tp')}""",
        f"select doc_id, {percent('h')} web_percent from mp",
    ),
    "tokens_offsets": with_(TOKENS, "select doc_id, k ix, token, s start_offset, e end_offset from tk"),
    "normalized_text": f"select doc_id, {normalized('text')} normalized from documents",
    "bank_chunks": with_(f"{TOKENS}, {fragments('f', BANK)}", f"{FRAGMENT} f"),
    "query_chunks_internal": with_(f"{TOKENS}, {fragments('f', INTERNAL_QUERY)}", f"{FRAGMENT} f"),
    "query_chunks_web": with_(f"{TOKENS}, {fragments('f', WEB_QUERY)}", f"{FRAGMENT} f"),
    "shingles": with_(
        f"{TOKENS}, {fragments('f', BANK)}, {shingled('s', 'f', 'doc_id, chunk_ix', 'c')}", "select distinct doc_id, chunk_ix, c n_shingles from s"
    ),
    "shingle_df": with_(
        f"{TOKENS}, {fragments('f', BANK)}, {shingled('s', 'f', 'doc_id, chunk_ix', 'c')}", "select sh shingle, count(*) n from s group by 1"
    ),
    "fragment_duplicates": with_(
        f"{TOKENS}, {fragments('f', BANK)}", "select sha256(t) content_hash, count(*) n from f group by t having count(*) > 1"
    ),
    "internal_pairs": with_(INTERNAL_PAIRS, f"select doc_id, chunk_ix, cand_doc, cand_chunk, k, z bonus, {percent('h')} matched_percent from sc"),
    "internal_best": with_(INTERNAL_BEST, f"select doc_id, chunk_ix, cand_doc, cand_chunk, {percent('h')} matched_percent from be"),
    "internal_top35": with_(
        INTERNAL_BEST,
        f"select doc_id, chunk_ix, cand_doc, cand_chunk, rank, start_offset, end_offset, {percent('h')} matched_percent from tp",
    ),
    "internal_percent": with_(
        f"{INTERNAL_BEST}, {matched('tp')}", f"select doc_id, {percent('h')} similarity_percent, {risk('h', '0')} risk_level from mp"
    ),
    "page_text": with_(PAGES, "select page_id, title, pt as text from pp"),
    "page_domain": f"select page_id, {DOMAIN} as domain from pages",
    "page_blocked": f"select page_id, {BLOCKED.format(url='url || e')} blocked from (select *, ['', '.PDF', '.Jpg?x=1'][(page_id % 3 + 1)::int] e from pages)",
    "web_pairs": with_(WEB_PAIRS, f"select doc_id, chunk_ix, page_id, k, z bonus, {percent('h')} matched_percent from sc"),
    "web_best": with_(WEB_BEST, f"select doc_id, chunk_ix, page_id, {percent('h')} matched_percent from be"),
    "web_excerpt": with_(
        f"""{WEB_BEST},
at_ as (select doc_id, chunk_ix, page_id, pp.pt, coalesce(
  {', '.join(f"nullif(strpos(ct, array_to_string(v[1:{n}], ' ')), 0)" for n in (10, 8, 6, 4))}) - 1 pos from be join pp using (page_id))""",
        f"select doc_id, chunk_ix, page_id, coalesce(substr(pt, greatest(0, pos - 180) + 1, pos + 720 - greatest(0, pos - 180)), substr(pt, 1, {EXCERPT})) excerpt from at_",
    ),
    "web_percent": with_(f"{WEB_BEST}, {matched('tp')}", f"select doc_id, {percent('h')} web_percent from mp"),
    "merged_ranges": with_(f"{RANGES}, {merged('rg')}", "select * from mg"),
    "total_percent": with_(f"{RANGES}, {matched('rg')}", f"select doc_id, {percent('h')} total_percent from mp"),
    "risk_level": with_(
        f"{RANGES}, {matched('rg')}, {SCORES}, {PROBABILITY}",
        f"select doc_id, {percent('h')} similarity_percent, {percent('ai')} ai_percent, {risk('h', 'ai')} risk_level from mp join pb using (doc_id)",
    ),
    "analysis_percents": with_(
        ANALYSIS,
        f"""select doc_id, {percent('hi.h')} internal_percent, {percent('hw.h')} web_percent, {percent('ht.h')} total_percent, {percent('ai')} ai_percent,
  {risk('ht.h', 'ai')} risk_level from hi join hw using (doc_id) join ht using (doc_id) join ha using (doc_id)""",
    ),
    "line_normalize": f"select doc_id, {line_breaks('text')} clean from documents",
    "reference_tail": rf"""
with t as (select doc_id, {line_breaks("case when doc_id % 3 = 0 then replace(text, '. ', '. Referencias ') else text end")} c from documents),
p as (select *, case when regexp_matches(lower(c), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(STOP_WORDS)})([^\p{{L}}\p{{N}}_]|$)')
  then length(regexp_extract(lower(c), '(?s)^(.*?(?:^|[^\p{{L}}\p{{N}}_]))(?:{'|'.join(STOP_WORDS)})(?:[^\p{{L}}\p{{N}}_]|$)', 1)) end pos from t)
select doc_id, pos as position, coalesce(pos * 100 >= length(c) * 45, false) has_tail,
  case when pos * 100 >= length(c) * 45 then length({strip('substr(c, 1, pos)')}) else length(c) end cut_length from p
""",
    "cover_flag": with_(
        CLEAN_PARAGRAPHS,
        f"""select doc_id, ix, {cover('m', 'ix')} cover
from (select *, substr('Tesis Universidad Facultad ', 1, (6 + 10 * (doc_id % 3))::int) || ' ' || paragraph m from cp)""",
    ),
    "low_value_flag": f"select doc_id, {low_value('p')} low_value from (select doc_id, {strip('text')} p from documents)",
    "filtered_text": with_(
        FILTERED,
        f"select doc_id, coalesce(nullif(content, ''), {PAGED}) content, coalesce(excluded, '') excluded from documents left join fl using (doc_id)",
    ),
    "paragraphs_offsets": with_(PARAGRAPHS, "select doc_id, start_offset, end_offset, sha256(paragraph) hash from pf"),
    "sentence_stats": with_(FEATURES, "select doc_id, start_offset, w, u, sentences, n, s, q, punctuation, chars from ft"),
    "lexicon_counts": with_(FEATURES, "select doc_id, start_offset, connectors, generic, personal from ft"),
    "style_score": with_(SCORES, "select doc_id, start_offset, score from so"),
    "style_probability": with_(f"{SCORES}, {PROBABILITY}", f"select doc_id, {percent('ai')} probability from pb"),
    "style_findings_top20": with_(
        f"{SCORES}, {STYLE_TOP}", f"select doc_id, rank, start_offset, end_offset, score, substr(paragraph, 1, {EXCERPT}) excerpt from sf"
    ),
    "search_phrases": with_(PHRASES, "select doc_id, unnest(generate_series(0, len(phrases) - 1)) ix, unnest(phrases) phrase from hf"),
    "search_queries": with_(QUERY_LISTS, "select doc_id, unnest(generate_series(0, len(queries) - 1)) ix, unnest(queries) as query from hi"),
    "highlight_segments": with_(
        HIGHLIGHTS,
        """select doc_id, row_number() over (partition by doc_id order by seg.a) - 1 seg_ix, sha256(substr(text, seg.a + 1, seg.b - seg.a)) hash, finding_type
from seg join documents using (doc_id)""",
        recursive=True,
    ),
    "report_summary_json": with_(
        f"{RANGES}, {matched('rg')}, {SCORES}, {PROBABILITY}, {FILTERED}",
        f"""select doc_id, {risk('h', 'ai')} risk_level, '{{"engine":"spark-shingles-v1","excluded_sections":[' ||
  array_to_string(list_transform(coalesce(labels, []), lambda x: '"' || x || '"'), ',') || ']}}' summary
from mp join pb using (doc_id) left join fl using (doc_id)""",
    ),
    "report_sources": with_(
        f"{renamed(INTERNAL_BEST, 'ti')}, {renamed(WEB_BEST, 'tw')}, {PAGES}",
        f"""select doc_id, 'INTERNAL' source_type, rank, 'document ' || cand_doc title, 'Repositorio interno' as domain, {percent('h')} matched_percent from ti
union all select doc_id, 'WEB', rank, title, domain, {percent('h')} from tw join pp using (page_id)""",
    ),
    "report_findings": with_(
        INTERNAL_BEST,
        f"""select doc_id, rank, start_offset, end_offset, sha256(substr(text, start_offset + 1, least(end_offset - start_offset, {EXCERPT}))) excerpt_hash
from tp join documents using (doc_id)""",
    ),
    "source_rollup": with_(INTERNAL_BEST, f"select doc_id, cand_doc, count(*) matches, {percent('max(h)')} best_percent from tp group by 1, 2"),
    "rls_documents": f"""
with {OWNED}
select 'student' scope, doc_id from d where owner_id = 7 union all select 'teacher', doc_id from d where institution_id = 3
union all select 'superuser', doc_id from d
""",
    "bank_candidates_5000": with_(
        f"{TOKENS}, {fragments('f', BANK)}",
        """select source, doc_id, chunk_ix, row_number() over (partition by source order by doc_id desc, chunk_ix desc) rank
from f join documents using (doc_id) qualify rank <= 5000""",
    ),
    "recent_documents": f"""
with {OWNED}
select institution_id, doc_id, row_number() over (partition by institution_id order by created_at desc, doc_id desc) rank from d qualify rank <= 10
""",
    "attempt_number": "select l_orderkey document_id, max(l_linenumber) + 1 attempt from lineitem group by 1",
    "login_lookup": "select c_name username, c_acctbal > 0 is_active from customer where lower(c_name) in ('customer#000000042', 'customer#000000043')",
    "admin_search": """
select p_partkey, p_name from part where p_size > 10
and (contains(lower(p_name), 'br') or contains(lower(p_brand), 'br') or contains(lower(p_type), 'br'))
and (contains(lower(p_name), 'a') or contains(lower(p_brand), 'a') or contains(lower(p_type), 'a'))
""",
    "constraint_violations": "select o_custkey, o_orderdate::date::varchar as day, count(*) n from orders group by 1, 2 having count(*) > 1",
    "documents_with_labels": "select doc_id, source, quality from documents left join labels using (doc_id)",
    "prefetched_orders": """
select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey), '') orders
from customer left join orders on o_custkey = c_custkey group by 1
""",
    "prefetched_order_rows": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
    "lifecycle_status": """
select user_id, count(*) steps, arg_max(event_type, (ts, event_id)) as last,
  case when arg_max(event_type, (ts, event_id)) <> 'error' then 'SUCCESS' else 'FAILED' end job_status,
  case when arg_max(event_type, (ts, event_id)) <> 'error' then 'COMPLETED' else 'FAILED' end document_status from events group by 1
""",
    "certificate_payload": f"""
with c as (select *, 'report-' || doc_id as key, (n_chars * 7 % 10001) s, 'VQ-2024-' || upper(substr(sha256('report-' || doc_id), 1, 8)) code from documents)
select doc_id, code, sha256(key || ':' || doc_id || ':' || code) verification_hash,
  'https://example.org/certificados/verificar/' || code || '/' url, (s // 100)::varchar || '.' || lpad((s % 100)::varchar, 2, '0') similarity,
  {risk('s', '0')} risk_level, source author from c
""",
    "upload_validation": """
select doc_id, case when doc_id % 5 = 0 then 'title' when doc_id % 7 = 0 then 'kind' when doc_id % 4 = 0 then 'file'
  when doc_id % 4 = 3 then 'extension' when n_chars * 5000 not between 1 and 26214400 then 'size' end reject_reason from documents
""",
    "merged_sessions": with_(
        f"""ev as (select user_id, floor(epoch(ts))::bigint start_offset, floor(epoch(ts))::bigint + 1800 end_offset from events), {merged('ev', 'user_id')}""",
        "select * from mg",
    ),
}
