"""Rules over the stored records: owners, students, certificates, roles, constraints, and the states of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.reports import certificate_code, error_messages, verification_hash

# Roles, states, and the labels of a job's last step.
ADMIN, TEACHER, STUDENT = "ADMIN", "TEACHER", "STUDENT"
COMPLETED, UPLOADED, PENDING = "COMPLETED", "UPLOADED", "PENDING"
LAST_STEP = {"SUCCESS": "Análisis completado", "FAILED": "Error durante el análisis"}
FIRST_STEP, LANGUAGE, NO_INSTITUTION = "Preparando análisis", "es", "pending"
#: Codes that are tried for a certificate.
ATTEMPTS = 10


def roles(users: DataFrame) -> DataFrame:
    """``users`` (role, is_superuser) with ``is_admin``, ``is_teacher`` and ``is_student``; superusers count as admins."""
    return users.withColumns(
        {
            "is_admin": (F.col("role") == ADMIN) | F.col("is_superuser"),
            "is_teacher": F.col("role") == TEACHER,
            "is_student": F.col("role") == STUDENT,
        }
    )


def without_institution(users: DataFrame) -> DataFrame:
    """Users who must have an institution and have none."""
    return users.where("not is_superuser and institution_id is null")


def available_students(users: DataFrame, role: str, is_superuser: bool = False, institution_id=None) -> DataFrame:
    """The active students that a user may choose from: students nobody, superusers all, others within their institution."""
    if role == STUDENT:
        return users.limit(0)
    students = users.where((F.col("role") == STUDENT) & F.col("is_active"))
    return students if is_superuser else students.where(F.col("institution_id") == F.lit(institution_id))


def resolved_owners(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """``uploads`` (id, uploaded_by, chosen) with ``owner_id`` or the ``reason`` why there is none.

    Students own what they upload; others choose an active student, superusers any, the rest of their institution.
    """
    by = users.select(F.col("id").alias("uploaded_by"), F.col("role").alias("by_role"), F.col("is_superuser").alias("by_super"), F.col("institution_id").alias("by_institution"))
    pool = users.where((F.col("role") == STUDENT) & F.col("is_active"))
    pool = pool.select(F.col("id").alias("chosen"), F.col("institution_id").alias("student_institution"), F.lit(True).alias("known"))
    rows = uploads.join(by, "uploaded_by").join(pool, "chosen", "left")
    own = F.col("by_role") == STUDENT
    allowed = F.col("known") & (F.col("by_super") | (F.col("student_institution") == F.col("by_institution")))
    reason = (
        F.when(own, None)
        .when(F.col("chosen").isNull(), "owner")
        .when(~F.col("by_super") & F.col("by_institution").isNull(), "institution")
        .when(~F.coalesce(allowed, F.lit(False)), "student")
    )
    rows = rows.withColumn("reason", reason)
    owner = F.when(own, F.col("uploaded_by")).when(F.col("reason").isNull(), F.col("chosen"))
    return rows.select(*uploads.columns, owner.alias("owner_id"), "reason")


def document_rows(uploads: DataFrame) -> DataFrame:
    """Rows as they are inserted: trimmed texts, the language, the first state and a private path."""
    ending = F.lower(F.regexp_extract("original_filename", r"\.([^.]*)$", 1))
    folder = F.coalesce(F.col("institution_id").cast("string"), F.lit(NO_INSTITUTION))
    path = F.concat_ws("/", F.lit("private/documents"), folder, F.date_format("created_at", "yyyy/MM"), F.concat(F.col("id").cast("string"), F.lit("."), ending))
    trimmed = {c: F.trim(c) for c in ("title", "course_name", "academic_period")}
    return uploads.withColumns({**trimmed, "language": F.lit(LANGUAGE), "status": F.lit(UPLOADED), "original_file": path})


def not_certifiable(is_final: Column, status: Column) -> Column:
    """Why a report cannot be certified, null if it can."""
    return F.when(~is_final, "not final").when(status != COMPLETED, "not completed")


def verified(certificates: DataFrame, hashes: DataFrame) -> DataFrame:
    """Active certificates of the verification hashes that are asked for."""
    return certificates.where("is_active").join(hashes.select("verification_hash").distinct(), "verification_hash", "left_semi")


def active_certificates(certificates: DataFrame) -> DataFrame:
    """The newest active certificate of each report."""
    newest = Window.partitionBy("report_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return certificates.where("is_active").withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def unused_codes(reports: DataFrame, certificates: DataFrame, prefix: str, year: Column) -> DataFrame:
    """(report_id, code): of each report's ATTEMPTS codes the first that no certificate has.

    Of reports of one run that come to the same code the smallest gets it; the others get none, as if all were taken.
    """
    tries = reports.select("report_id", year.alias("year"), F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("attempt"))
    code = certificate_code(prefix, F.col("year"), F.concat_ws("/", F.col("report_id").cast("string"), F.col("attempt").cast("string")))
    tries = tries.withColumn("code", code).join(certificates.select("code").distinct(), "code", "left_anti")
    first = tries.groupBy("report_id").agg(F.min(F.struct("attempt", "code")).alias("x")).select("report_id", "x.code")
    return first.groupBy("code").agg(F.min("report_id").alias("report_id")).select("report_id", "code")


def issued(reports: DataFrame, certificates: DataFrame, prefix: str, year: Column) -> DataFrame:
    """(report_id, code, verification_hash, created): the certificate of each certifiable report, an old one or a new one.

    ``reports`` is (report_id, document_id, is_final, status). An old certificate is active again, without a revocation.
    """
    sound = reports.where(not_certifiable(F.col("is_final"), F.col("status")).isNull())
    old = sound.join(certificates.select("report_id", "code", "verification_hash"), "report_id")
    rest = sound.join(certificates.select("report_id"), "report_id", "left_anti")
    new = rest.join(unused_codes(rest, certificates, prefix, year), "report_id")
    made = verification_hash(F.col("report_id").cast("string"), F.col("document_id").cast("string"), F.col("code"))
    old = old.select("report_id", "code", "verification_hash", F.lit(False).alias("created"))
    return old.unionByName(new.select("report_id", "code", made.alias("verification_hash"), F.lit(True).alias("created")))


def job_states(log: DataFrame) -> DataFrame:
    """The state of each job and of its document after its ``log`` (job_id, at, seq, kind, step, message).

    Kinds are start, step, success and failure; what comes after the last start counts.
    """
    last = Window.partitionBy("job_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    rows = log.withColumn("begun", F.max(F.when(F.col("kind") == "start", F.struct("at", "seq"))).over(Window.partitionBy("job_id")))
    return states(rows.withColumn("rn", F.row_number().over(last)).where("rn = 1"))


def states(rows: DataFrame) -> DataFrame:
    """The state of each job from its last event (job_id, at, seq, kind, step, message) and ``begun``, the (at, seq) of its last start.

    An event before the job's start changes nothing.
    """
    known = F.col("begun").isNotNull() & (F.struct("at", "seq") >= F.col("begun"))
    status = F.when(~F.coalesce(known, F.lit(False)), PENDING).when(F.col("kind") == "success", "SUCCESS").when(F.col("kind") == "failure", "FAILED").otherwise("RUNNING")
    rows = rows.withColumn("job_status", status)
    document = F.when(F.col("job_status") == PENDING, UPLOADED).when(F.col("job_status") == "SUCCESS", COMPLETED)
    document = document.when(F.col("job_status") == "FAILED", "FAILED").otherwise("PROCESSING")
    ended, failed = F.col("job_status").isin(*LAST_STEP), F.col("job_status") == "FAILED"
    step = F.when(F.col("job_status") == PENDING, FIRST_STEP).otherwise(F.col("step"))
    for state, label in LAST_STEP.items():
        step = F.when(F.col("job_status") == state, label).otherwise(step)
    for_document, for_job = error_messages(F.col("message"))
    return rows.select(
        "job_id",
        "job_status",
        document.alias("document_status"),
        step.alias("current_step"),
        F.col("begun.at").alias("started_at"),
        F.when(ended, F.col("at")).alias("finished_at"),
        F.when(failed, for_document).otherwise("").alias("document_error"),
        F.when(failed, for_job).otherwise("").alias("job_error"),
    )


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): the rules that rows break; a rule that is null for a row is kept by it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``position`` in an order within a group."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
