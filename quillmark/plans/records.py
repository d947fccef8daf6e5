"""Registered queries of the rules over stored records.

Stand-ins: customers are users, orders their documents; two of three orders have a report of the same number, every fourth
of these a certificate. Roles, names and states are rules of the numbers, which the SQL repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, records, similarity, style
from quillmark.operators.chunks import chunks
from quillmark.operators.reports import latest
from quillmark.params import BANK, BANK_NEWEST, INTERNAL, INTERNAL_QUERY
from quillmark.plans.catalog import docs, internal_best_of, paged, web_best_of
from quillmark.plans.catalog import fragments as fragments_of
from quillmark.plans.oracle import INTERNAL_PAIRS, SCORES, STYLE_TOP, TOKENS, WEB_BEST, best, fragments, line_breaks, matched, scored, shingled, strip, with_
from quillmark.sources import docx, keyed
from quillmark.sources.scratch import new_folder, stored
from quillmark.sources.tables import table

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


USERS = """c_custkey as id, case when c_custkey % 50 <> 0 then c_nationkey end as institution_id,
  case when c_custkey % 10 = 0 then 'ADMIN' when c_custkey % 10 = 1 then 'TEACHER' else 'STUDENT' end as role,
  c_custkey % 97 = 0 as is_superuser, c_acctbal > 0 as is_active, c_mktsegment as first_name, c_name as last_name,
  lower(c_name) as username"""
DOCUMENTS = """o_orderkey as id, o_custkey as owner_id, o_orderdate as created_at,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PROCESSING' else 'FAILED' end as status"""
REPORTS = "id as report_id, id as document_id, id % 5 <> 0 as is_final, status, created_at"
CERTIFICATES = """report_id + 1000000000 as id, report_id, 'VQ-2023-' || cast(report_id as string) as code,
  'h' || cast(report_id * 7 as string) as verification_hash, report_id % 7 <> 0 as is_active, created_at"""
#: In SQL, reports and certificates carry the scope of their document; here they are tables of their own.
SCOPE = ", owner_id, institution_id"


def users(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(f"struct({USERS}) as x").select("x.*")


def documents(spark, sf_dir) -> DataFrame:
    owners = users(spark, sf_dir).selectExpr("id as owner_id", "institution_id")
    return table(spark, sf_dir, "orders").selectExpr(f"struct({DOCUMENTS}) as x").select("x.*").join(owners, "owner_id")


def reports(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).where("id % 3 <> 0").selectExpr(f"struct({REPORTS}) as x").select("x.*")


def certificates(spark, sf_dir) -> DataFrame:
    return reports(spark, sf_dir).where("report_id % 4 = 1").selectExpr(f"struct({CERTIFICATES}) as x").select("x.*")


#: A student, a teacher, a superuser, a superuser with a student's role, and a teacher of no institution.
ASKING = {
    "student": (7, "STUDENT", False, 3), "teacher": (8, "TEACHER", False, 3), "superuser": (9, "ADMIN", True, None),
    "student superuser": (7, "STUDENT", True, 3), "stranger": (10, "TEACHER", False, None),
}


def _scopes(rows: DataFrame, parents: list, key: str) -> DataFrame:
    """What each of ASKING may see."""
    seen = [access.visible_through(rows, parents, *who).select(F.lit(name).alias("scope"), key) for name, who in ASKING.items()]
    return reduce(DataFrame.union, seen)


@query
def rls_reports(spark, sf_dir):
    return _scopes(reports(spark, sf_dir), [(documents(spark, sf_dir), "document_id", "id")], "report_id")


@query
def rls_certificates(spark, sf_dir):
    parents = [(reports(spark, sf_dir), "report_id", "report_id"), (documents(spark, sf_dir), "document_id", "id")]
    return _scopes(certificates(spark, sf_dir).where("is_active"), parents, "code")


def certificate_rows(spark, sf_dir) -> DataFrame:
    """Certificates with their report, its document, and that document's owner and institution."""
    c = certificates(spark, sf_dir).select("id", "code", "verification_hash", "is_active", "report_id")
    r = reports(spark, sf_dir).select("report_id", "document_id", "is_final", "status")
    d = documents(spark, sf_dir).selectExpr("id as document_id", "'Work ' || id as title", "owner_id", "institution_id")
    u = users(spark, sf_dir).selectExpr("id as owner_id", "username", "username || '@example.org' as email", "role")
    return c.join(r, "report_id").join(d, "document_id").join(u, "owner_id")


@query
def certificate_paths(spark, sf_dir):
    """Each certificate with what lies three relations away."""
    rows = certificate_rows(spark, sf_dir)
    return rows.select("id", "code", "report_id", "document_id", "title", "status", "owner_id", "username", "institution_id")


#: What the search over certificates looks for, in its own and in joined fields, and what it counts.
CERTIFICATE_SEARCH = ("vq-2023-1 #00 7", ["code", "verification_hash", "title", "username", "email"], ["is_active", "status", "institution_id", "role"])


@query
def certificate_search_facets(spark, sf_dir):
    """Certificates that hold every term in some field, their own or a joined one, counted by each facet."""
    terms, fields, facets = CERTIFICATE_SEARCH
    rows = stored(certificate_rows(spark, sf_dir))
    found = access.indexed_search(rows, access.trigram_index(rows, "id", fields), terms, "id", fields)
    return access.faceted(found, facets)


@query
def resolved_owners(spark, sf_dir):
    """Each customer uploads for the one that follows two numbers later, some for nobody."""
    uploads = users(spark, sf_dir).selectExpr("id", "id as uploaded_by", "case when id % 13 <> 0 then id + 2 end as chosen")
    return records.resolved_owners(uploads, users(spark, sf_dir)).select("id", "owner_id", "reason")


@query
def available_students(spark, sf_dir):
    """The choice of a teacher, a superuser and a student, by first, last and user name."""
    u, out = users(spark, sf_dir), None
    for name, who in {"teacher": ("TEACHER", False, 3), "superuser": ("ADMIN", True), "student": ("STUDENT", True, 3)}.items():
        rows = records.available_students(u, *who).select(F.lit(name).alias("scope"), "id", "first_name", "last_name", "username")
        out = rows if out is None else out.union(rows)
    order = [F.col(c) for c in ("first_name", "last_name", "username")]
    return records.positions(out, "scope", order).select("scope", "id", "position")


@query
def document_rows(spark, sf_dir):
    rows = documents(spark, sf_dir).selectExpr(
        "id", "institution_id", "created_at", "'  T ' || id as title", "' c ' as course_name", "'' as academic_period",
        "if(id % 2 = 0, 'a.b.PDF', 'x.docx') as original_filename",
    )
    return records.document_rows(rows).select("id", "title", "course_name", "academic_period", "language", "status", "original_file")


@query
def verified_certificates(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("'h' || cast(o_orderkey as string) as verification_hash")
    return records.verified(certificates(spark, sf_dir), asked).select("code", "report_id")


@query
def active_certificates(spark, sf_dir):
    """Certificates of ten reports are taken as one report's."""
    rows = certificates(spark, sf_dir).withColumn("report_id", F.expr("report_id div 10"))
    return records.active_certificates(rows).select("report_id", "code")


@query
def certificate_eligibility(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", records.not_certifiable(F.col("is_final"), F.col("status")).alias("reason"))


@query
def issued_certificates(spark, sf_dir):
    return records.issued(reports(spark, sf_dir), certificates(spark, sf_dir), "VQ", F.lit(2024))


@query
def role_predicates(spark, sf_dir):
    return records.roles(users(spark, sf_dir)).select("id", "is_admin", "is_teacher", "is_student")


@query
def users_without_institution(spark, sf_dir):
    return records.without_institution(users(spark, sf_dir)).select("id")


@query
def job_states(spark, sf_dir):
    """Events as a log: purchases begin a job, clicks are steps, sign-ups end it well and errors badly."""
    kinds = "case event_type when 'purchase' then 'start' when 'signup' then 'success' when 'error' then 'failure' else 'step' end"
    log = table(spark, sf_dir, "events").selectExpr(
        "user_id as job_id", "ts as at", "event_id as seq", f"{kinds} as kind", "event_type as step", "repeat(event_type, 500) as message"
    )
    rows = records.job_states(log)
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")]
    lengths = [F.length(c).cast("long").alias(c) for c in ("document_error", "job_error")]
    return rows.select("job_id", "job_status", "document_status", "current_step", *times, *lengths)


@query
def check_violations(spark, sf_dir):
    """Sizes, percents and ranges that a check constraint would refuse."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_size - 3 as file_size_bytes", "p_retailprice / 10 - 95 as percent", "p_size as start_offset", "p_size + p_partkey % 3 as end_offset")
    rules = {"size": F.col("file_size_bytes") >= 1, "percent": F.col("percent").between(0, 100), "range": F.col("end_offset") > F.col("start_offset")}
    return records.violations(rows, "id", rules)


@query
def repeated_document_numbers(spark, sf_dir):
    """A user's number, if it is not empty, is unique within the institution."""
    rows = users(spark, sf_dir).selectExpr("institution_id", "if(id % 4 = 0, '', cast(id % 30 as string)) as document_number")
    return access.repeated_keys(rows.where("document_number <> '' and institution_id is not null"), ["institution_id", "document_number"])


@query
def default_orders(spark, sf_dir):
    """Places in the models' own orders: documents of an owner and certificates of an institution newest first."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    d = records.positions(documents(spark, sf_dir), "owner_id", newest).select(F.lit("document").alias("model"), "id", "position")
    held = certificates(spark, sf_dir).join(reports(spark, sf_dir).select("report_id", "document_id"), "report_id")
    held = held.join(documents(spark, sf_dir).selectExpr("id as document_id", "institution_id"), "document_id")
    c = records.positions(held, "institution_id", newest).select(F.lit("certificate").alias("model"), "id", "position")
    return d.union(c)


@query
def indexed_counts(spark, sf_dir):
    """Fragments that indexing each document adds to the bank."""
    return chunks(docs(spark, sf_dir), BANK).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def report_web_findings(spark, sf_dir):
    """A finding for each of a report's web matches, keyed by its rank, as it replaces those of the last run."""
    top = similarity.top_matches(web_best_of(spark, sf_dir))
    return top.select("doc_id", "rank", "page_id", "start_offset", "end_offset", T.percent(F.col("hundredths")).alias("confidence"))


@query
def institution_percent(spark, sf_dir):
    """Similarity with the newest fragments of the document's own institution only, as an analysis takes its candidates."""
    source = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("within"))
    d = docs(spark, sf_dir)
    made = fragments_of(d, INTERNAL_QUERY)
    bank = made.where(F.col("word_count") >= BANK.least).join(source, "doc_id").where("within is not null")
    bank = latest(bank, "within", [F.col("doc_id").desc(), F.col("chunk_ix").desc()], BANK_NEWEST)
    bank = stored(bank.select(F.col("doc_id").alias("cand_doc"), F.col("chunk_ix").alias("cand_chunk"), "normalized_text", "within"))
    asked = made.drop("word_count").join(source, "doc_id")
    top = similarity.top_matches(internal_best_of(asked, bank))
    return similarity.matched_percent(d, top).select("doc_id", T.percent(F.col("hundredths")).alias("similarity_percent"))


def earlier_scores(asked: DataFrame, bank: DataFrame, buckets: int = 64) -> DataFrame:
    """Best score of each fragment of ``asked`` with a fragment of the bank that arrived before it (owner below doc_id).

    The bank's postings are kept in buckets; what arrives is dealt to these, and the bank stays where it is.
    """
    first = bank.groupBy("normalized_text").agg(F.min("cand_doc").alias("first"))
    scores = similarity.scores(similarity.sides(asked, bank, "doc_id", "cand_doc"), INTERNAL, True, True, buckets)
    pairs = similarity.every_pair(scores, asked, first).where(F.col("first") < F.col("doc_id"))
    return similarity.best_of_chunk(pairs, ["doc_id", "chunk_ix"], [F.col("first")])


@query
def asof_percent(spark, sf_dir):
    """Similarity of each document with what was in the bank when it arrived."""
    d = docs(spark, sf_dir)
    made = fragments_of(d, INTERNAL_QUERY)
    bank = made.where(F.col("word_count") >= BANK.least).select(F.col("doc_id").alias("cand_doc"), "normalized_text")
    top = similarity.top_matches(earlier_scores(made.drop("word_count"), bank))
    return similarity.matched_percent(d, top).select("doc_id", T.percent(F.col("hundredths")).alias("similarity_percent"))


@query
def replaced_findings(spark, sf_dir):
    """Style findings on storage after two runs: one over all documents, one over each third with every other finding, scored anew."""
    d = paged(spark, sf_dir)
    found = stored(style.findings(style.scores(d)).select("doc_id", "rank", "start_offset", "end_offset", F.col("score").cast("long").alias("score")))
    path = new_folder(spark, "findings")
    keyed.replace(found, d, path, "doc_id")
    again = d.where("doc_id % 3 = 0")
    keyed.replace(found.where("rank % 2 = 1").withColumn("score", F.col("score") + 1), again, path, "doc_id")
    return keyed.read(spark, path, found.schema)


@query
def reindexed_bank(spark, sf_dir):
    """The bank on storage after all documents were indexed, and each fourth anew with the first half of its text."""
    d, path = docs(spark, sf_dir), new_folder(spark, "bank")
    index = lambda texts: chunks(texts, BANK).select("doc_id", "chunk_ix", "start_offset", "end_offset", "content_hash")
    keyed.replace(index(d), d, path, "doc_id")
    changed = d.where("doc_id % 4 = 0").withColumn("text", F.expr("substring(text, 1, cast(length(text) div 2 as int))"))
    keyed.replace(index(changed), changed, path, "doc_id")
    return keyed.read(spark, path, index(d).schema)


@query
def docx_round_trip(spark, sf_dir):
    """Documents written as DOCX files and read back: the text that an upload of each would have."""
    path = new_folder(spark, "uploads")
    docx.write(docs(spark, sf_dir).select(F.col("doc_id").alias("name"), "text"), path)
    rows = docx.read(spark, path).where("error is null")
    name = F.regexp_extract("path", r"([^/]*)\.docx$", 1).cast("long")
    return rows.select(name.alias("doc_id"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


SHARED = f"""
u as (select {USERS.replace("string", "varchar")} from customer),
d as (select x.*, u.institution_id from (select {DOCUMENTS} from orders) x join u on u.id = x.owner_id),
r as (select {REPORTS}{SCOPE} from d where id % 3 <> 0),
ce as (select {CERTIFICATES.replace("string", "varchar")}{SCOPE} from r where report_id % 4 = 1)"""


def _scoped(rows: str, key: str) -> str:
    return f"""with {SHARED}
select 'student' as scope, {key} from {rows} where owner_id = 7
union all select 'teacher', {key} from {rows} where institution_id = 3
union all select 'superuser', {key} from {rows}
union all select 'student superuser', {key} from {rows} where owner_id = 7"""


def _code(report: str, attempt: str) -> str:
    return f"'VQ-2024-' || upper(substr(sha256({report} || '/' || {attempt}), 1, 8))"


ORACLE_SQL = {
    "rls_reports": _scoped("r", "report_id"),
    "rls_certificates": _scoped("(select * from ce where is_active)", "code"),
    "certificate_paths": f"""with {SHARED}
select ce.id, ce.code, ce.report_id, d.id document_id, 'Work ' || d.id title, r.status, d.owner_id, u.username, d.institution_id
from ce join r using (report_id) join d on d.id = r.document_id join u on u.id = d.owner_id""",
    "certificate_search_facets": f"""with {SHARED},
x as (select ce.code, ce.verification_hash, ce.is_active, r.status, d.institution_id, u.role, 'Work ' || d.id title, u.username, u.username || '@example.org' email
  from ce join r using (report_id) join d on d.id = r.document_id join u on u.id = d.owner_id),
s as (select *, lower(concat_ws(chr(10), code, verification_hash, title, username, email)) t from x),
f as (select * from s where {' and '.join(f"contains(t, '{t}')" for t in CERTIFICATE_SEARCH[0].split())})
{' union all '.join(f"select '{c}' facet, {c}::varchar as value, count(*) n from f group by 2" for c in CERTIFICATE_SEARCH[2])}""",
    "resolved_owners": f"""with {SHARED},
j as (select b.id, b.role, b.is_superuser su, b.institution_id bi, case when b.id % 13 <> 0 then b.id + 2 end chosen, s.id sid, s.institution_id si
  from u b left join u s on s.id = case when b.id % 13 <> 0 then b.id + 2 end and s.role = 'STUDENT' and s.is_active),
k as (select *, case when role = 'STUDENT' then null when chosen is null then 'owner' when not su and bi is null then 'institution'
  when not coalesce(sid is not null and (su or si = bi), false) then 'student' end reason from j)
select id, case when role = 'STUDENT' then id when reason is null then chosen end owner_id, reason from k""",
    "available_students": f"""with {SHARED},
a as (select 'teacher' as scope, * from u where institution_id = 3 union all select 'superuser', * from u)
select scope, id, row_number() over (partition by scope order by first_name, last_name, username) as position
from a where role = 'STUDENT' and is_active""",
    "document_rows": f"""with {SHARED}
select id, 'T ' || id title, 'c' course_name, '' academic_period, 'es' as language, 'UPLOADED' status,
  'private/documents/' || coalesce(institution_id::varchar, 'pending') || '/' || strftime(created_at, '%Y/%m') || '/' || id
  || case when id % 2 = 0 then '.pdf' else '.docx' end original_file from d""",
    "verified_certificates": f"""with {SHARED}
select code, report_id from ce where is_active and verification_hash in (select 'h' || o_orderkey from orders)""",
    "active_certificates": f"""with {SHARED}
select report_id // 10 report_id, code from ce where is_active
qualify row_number() over (partition by report_id // 10 order by created_at desc, id desc) = 1""",
    "certificate_eligibility": f"""with {SHARED}
select report_id, case when not is_final then 'not final' when status <> 'COMPLETED' then 'not completed' end reason from r""",
    "issued_certificates": f"""with {SHARED},
s as (select * from r where is_final and status = 'COMPLETED'),
n as (select report_id, document_id from s where report_id not in (select report_id from ce)),
t as (select report_id, document_id, a, {_code('report_id', 'a')} code from n, generate_series(1, 10) g(a)),
f as (select report_id, document_id, arg_min(code, a) code from t where code not in (select code from ce) group by 1, 2),
w as (select * from f qualify row_number() over (partition by code order by report_id) = 1)
select report_id, code, verification_hash, false created from s join ce using (report_id)
union all select report_id, code, sha256(report_id || ':' || document_id || ':' || code), true from w""",
    "role_predicates": f"""with {SHARED}
select id, role = 'ADMIN' or is_superuser is_admin, role = 'TEACHER' is_teacher, role = 'STUDENT' is_student from u""",
    "users_without_institution": f"with {SHARED} select id from u where not is_superuser and institution_id is null",
    "job_states": """
with l as (select user_id job_id, ts, event_id, event_type,
  case event_type when 'purchase' then 'start' when 'signup' then 'success' when 'error' then 'failure' else 'step' end kind from events),
b as (select job_id, max(row(ts, event_id)) filter (kind = 'start') begun, max(ts) filter (kind = 'start') started from l group by 1),
e as (select l.*, started, begun is not null and row(ts, event_id) >= begun known from l join b using (job_id)
  qualify row_number() over (partition by job_id order by ts desc, event_id desc) = 1),
s as (select *, case when not known then 'PENDING' when kind = 'success' then 'SUCCESS' when kind = 'failure' then 'FAILED' else 'RUNNING' end job_status from e)
select job_id, job_status, case job_status when 'PENDING' then 'UPLOADED' when 'SUCCESS' then 'COMPLETED' when 'FAILED' then 'FAILED' else 'PROCESSING' end document_status,
  case job_status when 'SUCCESS' then 'Análisis completado' when 'FAILED' then 'Error durante el análisis' when 'PENDING' then 'Preparando análisis' else event_type end current_step,
  strftime(started, '%Y-%m-%d %H:%M:%S') started_at, case when job_status in ('SUCCESS', 'FAILED') then strftime(ts, '%Y-%m-%d %H:%M:%S') end finished_at,
  case when job_status = 'FAILED' then least(1000, length(event_type) * 500) else 0 end document_error,
  case when job_status = 'FAILED' then least(2000, length(event_type) * 500) else 0 end job_error from s""",
    "check_violations": """
select p_partkey id, 'size' as rule from part where p_size - 3 < 1
union all select p_partkey, 'percent' from part where not p_retailprice / 10 - 95 between 0 and 100
union all select p_partkey, 'range' from part where p_partkey % 3 = 0""",
    "repeated_document_numbers": f"""with {SHARED}
select institution_id, (id % 30)::varchar document_number, count(*) n from u
where id % 4 <> 0 and institution_id is not null group by 1, 2 having count(*) > 1""",
    "default_orders": f"""with {SHARED}
select 'document' as model, id, row_number() over (partition by owner_id order by created_at desc, id desc) as position from d
union all select 'certificate', id, row_number() over (partition by institution_id order by created_at desc, id desc) from ce""",
    "indexed_counts": with_(f"{TOKENS}, {fragments('f', BANK)}", "select doc_id, count(*) n from f group by 1"),
    "institution_percent": with_(
        f"""{TOKENS}, {fragments('qi', INTERNAL_QUERY)}, {fragments('bf', BANK)},
bk as (select bf.* from bf join documents using (doc_id) where source is not null
  qualify row_number() over (partition by source order by doc_id desc, chunk_ix desc) <= {BANK_NEWEST}),
{shingled('qs', 'qi', 'doc_id, chunk_ix', 'c')}, {shingled('bs', 'bk', 'doc_id, chunk_ix', 'p')},
pr as (select q.doc_id, q.chunk_ix, b.doc_id cand_doc, b.chunk_ix cand_chunk, c, p, count(*) k
  from qs q join documents x on x.doc_id = q.doc_id join bs b on q.sh = b.sh and q.doc_id <> b.doc_id
  join documents y on y.doc_id = b.doc_id and y.source = x.source group by all),
pt as (select pr.*, qi.start_offset, qi.end_offset, qi.t qt, bk.t ct from pr join qi using (doc_id, chunk_ix)
  join bk on bk.doc_id = cand_doc and bk.chunk_ix = cand_chunk),
{scored('pt', INTERNAL)}, {best('cand_doc desc, cand_chunk desc')}, {matched('tp')}""",
        "select doc_id, (h::decimal(7,0) / 100)::decimal(5,2) similarity_percent from mp",
    ),
    "reindexed_bank": with_(
        f"""dd as (select doc_id, case when doc_id % 4 = 0 then substr(text, 1, length(text) // 2) else text end as text from documents),
rf as (with documents as (select * from dd), {TOKENS}, {fragments('f', BANK)} select * from f)""",
        "select doc_id, chunk_ix, start_offset, end_offset, sha256(t) content_hash from rf",
    ),
    "docx_round_trip": rf"""
with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x:
  {strip(r"regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')")}), lambda x: x <> '') p from documents),
c as (select doc_id, {line_breaks("array_to_string(p, chr(10))")} t from l)
select doc_id, length(t)::bigint n_chars, sha256(t) content_sha256 from c""",
    "asof_percent": with_(
        f"{INTERNAL_PAIRS.replace('q.doc_id <> b.doc_id', 'b.doc_id < q.doc_id')}, {best('cand_doc desc, cand_chunk desc')}, {matched('tp')}",
        "select doc_id, (h::decimal(7,0) / 100)::decimal(5,2) similarity_percent from mp",
    ),
    "replaced_findings": with_(
        f"{SCORES}, {STYLE_TOP}",
        """select doc_id, rank, start_offset, end_offset, score from sf where doc_id % 3 <> 0
union all select doc_id, rank, start_offset, end_offset, score + 1 from sf where doc_id % 3 = 0 and rank % 2 = 1""",
    ),
    "report_web_findings": with_(WEB_BEST, "select doc_id, rank, page_id, start_offset, end_offset, (h::decimal(7,0) / 100)::decimal(5,2) confidence from tp"),
}
