"""Kept selections, results, templates and logs as keyed tables: versions read alike, collisions resolved, nothing lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut
from ..operators.scoring import ranked

#: Days that a selection is kept where nothing else is said.
KEPT_DAYS = 30
VERSION = 2
SELECTION = "version int, id string, created timestamp, updated timestamp, expires timestamp, closed boolean, closed_at timestamp, title string, form string, result string"
#: The two kinds of files that hold a selection; older ones hold only a result.
FILES = f"kind string, savedAt timestamp, selection struct<{SELECTION.replace(' string', ':string').replace(' timestamp', ':timestamp').replace(' boolean', ':boolean').replace(' int', ':int')}>, requirements struct<jobTitle:string>, result string"
#: Columns of the relational tables, audit last: it is only appended to.
RELATIONS = {
    "job_requirements": "id string, title string, description string, rubric_json string, rubric_version int, retention_days int, status string, created_by string, created_at timestamp",
    "candidates": "id bigint, job_id string, source_email string, status string, created_at timestamp",
    "documents": "id bigint, candidate_id bigint, name string, kind string, content_key string, size_bytes bigint, created_at timestamp",
    "extractions": "id bigint, document_id bigint, candidate_id bigint, schema_version string, qualification_json string, identity_json string, dual_path_status string, model string, created_at timestamp",
    "flags": "id bigint, document_id bigint, candidate_id bigint, type string, severity string, location string, evidence string, method string, created_at timestamp",
    "scores": "id bigint, candidate_id bigint, job_id string, rubric_version int, total double, breakdown_json string, created_at timestamp",
    "decisions": "id bigint, candidate_id bigint, job_id string, decision string, rationale string, score_shown double, created_by string, created_at timestamp",
    "audit_log": "id bigint, entity string, entity_id string, action string, actor string, detail_json string, created_at timestamp",
}


def stamp(at: Column) -> Column:
    """The minute as an id."""
    return F.date_format(at, "yyyyMMdd-HHmm")


def valid_id(c: Column) -> Column:
    """A minute's id, perhaps with a suffix of one or two digits."""
    return F.coalesce(c.rlike(r"^[0-9]{8}-[0-9]{4}(?:-[0-9]{1,2})?$"), F.lit(False))


def days_left(expires: Column, now: Column) -> Column:
    """Whole days until then, begun ones counted; below zero once it is over."""
    return F.ceil((F.unix_micros(expires) - F.unix_micros(now)) / 86_400_000_000)


def locked(closed: Column, expires: Column, now: Column) -> Column:
    """Closed, or over; what has no end is never over."""
    return F.coalesce(closed, F.lit(False)) | F.coalesce(now > expires, F.lit(False))


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """(``SELECTION``) of exported files, one JSON value a file: selections as they are, older results as a selection
    without a form. Ids that aren't valid become the minute of creation; files of other kinds have no row."""
    text = spark.read.text(path, wholetext=True)
    f = text.select(F.from_json("value", FILES).alias("f")).select("f.*")
    whole = f.where("kind = 'selection' AND selection IS NOT NULL").select("selection.*")
    older = f.where("kind = 'evaluation' AND result IS NOT NULL").select(
        F.lit(VERSION).alias("version"), F.lit(None).cast("string").alias("id"), F.col("savedAt").alias("created"), F.col("savedAt").alias("updated"), F.lit(None).cast("timestamp").alias("expires"), F.lit(False).alias("closed"),
        F.lit(None).cast("timestamp").alias("closed_at"), F.coalesce("requirements.jobTitle", F.lit("")).alias("title"), F.lit(None).cast("string").alias("form"), "result",
    )
    s = whole.unionByName(older)
    return s.withColumn("id", F.when(valid_id(F.col("id")), F.col("id")).otherwise(stamp("created"))).withColumn("expires", F.coalesce("expires", F.date_add("created", KEPT_DAYS).cast("timestamp")))


def slim(results: DataFrame) -> DataFrame:
    """Results without the extractions that only a cache needs."""
    return results.drop("doc_extracts")


def migrated(sessions: DataFrame) -> DataFrame:
    """(``SELECTION``) from the older single sessions (saved_at, title, form, result), each under its minute."""
    at = F.col("saved_at")
    return sessions.where(at.isNotNull()).select(
        F.lit(VERSION).alias("version"), stamp(at).alias("id"), at.alias("created"), at.alias("updated"), F.date_add(at, KEPT_DAYS).cast("timestamp").alias("expires"), F.lit(False).alias("closed"), F.lit(None).cast("timestamp").alias("closed_at"),
        F.coalesce("title", F.lit("")).alias("title"), "form", "result",
    )


def alongside(kept: DataFrame, incoming: DataFrame, order: str = "created") -> DataFrame:
    """``incoming`` with ids that neither ``kept`` nor another incoming row has: the first of an id keeps it if it is free, the
    others get the smallest suffixes from 2 that are free, in order. Ids' suffixes are compared as sets, per base id."""
    base = F.regexp_replace("id", r"^([0-9]{8}-[0-9]{4})-[0-9]{1,2}$", "$1")
    number = F.coalesce(F.nullif(F.regexp_extract("id", r"^[0-9]{8}-[0-9]{4}-([0-9]{1,2})$", 1), F.lit("")).cast("int"), F.lit(1))
    used = kept.select(base.alias("__base"), number.alias("__n")).groupBy("__base").agg(F.collect_set("__n").alias("__used"))  # at most a hundred to a base
    new = ranked(incoming.withColumn("__base", base), "__base", [F.asc(order), F.asc("title")]).drop("n")
    met = new.join(used, "__base", "left").withColumn("__used", F.coalesce("__used", F.array().cast("array<int>")))
    n = F.aggregate(F.array_sort("__used"), F.col("rank").cast("int"), lambda at, taken: F.when(taken <= at, at + 1).otherwise(at))
    return met.withColumn("id", F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), n.cast("string")))).drop("__base", "__used", "rank")


def imported(kept: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """kept with the incoming selections: under their own ids, replacing those that have them, or beside them."""
    if overwrite:
        return kept.join(incoming.select("id").distinct(), "id", "left_anti").unionByName(incoming)
    return kept.unionByName(alongside(kept, incoming))


def extended(selections: DataFrame, ids: DataFrame, days: int, now: Column) -> DataFrame:
    """The selections of ``ids`` run for ``days`` from now on and are open again; none is ever deleted."""
    s = selections.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull()
    return s.withColumns({"expires": F.when(hit, now + F.make_dt_interval(F.lit(days))).otherwise(F.col("expires")), "closed": F.when(hit, False).otherwise(F.col("closed")), "closed_at": F.when(~hit, F.col("closed_at")), "updated": F.when(hit, now).otherwise(F.col("updated"))}).drop("__hit")


def closed(selections: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The selections of ``ids`` that are not locked yet are closed from now on."""
    s = selections.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull() & ~locked(F.col("closed"), F.col("expires"), now)
    return s.withColumns({"closed": F.when(hit, True).otherwise(F.col("closed")), "closed_at": F.when(hit, now).otherwise(F.col("closed_at")), "updated": F.when(hit, now).otherwise(F.col("updated"))}).drop("__hit")


def versioned(kept: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """The rows of ``incoming`` (key, content) that differ from the newest of ``kept`` (key, content, version), each with the
    next version; new keys begin at 1. Older versions stay, so a score can name the one that it used."""
    newest = kept.groupBy(key).agg(F.max_by(F.struct(*content), "version").alias("__old"), F.max("version").alias("__v"))
    met = incoming.join(newest, key, "left")
    return met.where(F.col("__v").isNull() | ~F.struct(*content).eqNullSafe(F.col("__old"))).select(*incoming.columns, (F.coalesce("__v", F.lit(0)) + 1).alias("version"))


def write_relation(df: DataFrame, name: str, path: str) -> None:
    """Writes rows to one of ``RELATIONS``, cast to its columns; columns that are missing are null, unknown ones an error.
    The audit log is appended to, the others are replaced whole."""
    columns = [c.strip().rsplit(" ", 1) for c in RELATIONS[name].split(", ")]
    unknown = set(df.columns) - {c for c, _ in columns}
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    shaped = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])
    if name != "audit_log":
        shaped = cut(shaped)  # the table may be read while it is replaced
    shaped.write.mode("append" if name == "audit_log" else "overwrite").parquet(f"{path}/{name}")


def read_relation(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(RELATIONS[name]).parquet(f"{path}/{name}")
