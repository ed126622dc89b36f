"""End to end: kept answers to rankings, files to texts, and streams, over the tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import shared_folder, spread, table
from ..operators import extraction, findings, reports, scoring
from ..sources import dispatch
from ..streaming import ingest
from . import facts, screening

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WEIGHTS = {"years": 25.0, "skills": 30.0, "education": 15.0, "tenure": 10.0, "certifications": 10.0}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def evaluate(files: DataFrame, answers: DataFrame, required: list[str], points: dict[str, float], images=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scans, misses, scores): files (path, content, candidate_id) scanned, their kept answers (path, raw) merged by candidate
    and scored; misses are the texts without a kept answer. Identity is no part of the score."""
    scans = dispatch.scan(files, images).join(files.select("path", "candidate_id"), "path")
    hits, misses = extraction.extract(scans.where("ok").select("path", "candidate_id", "visible"), answers, "path", "visible")
    return scans, misses, rescore(hits, "candidate_id", required, points)


def rescore(answers: DataFrame, key: str, required: list[str], points: dict[str, float], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, total) of sanitized answers merged by key: no file is read and no model asked again."""
    return scoring.totals(scoring.merged_breakdown(answers, key, weights or _WEIGHTS, required, points), key)


_RESCORED = f"""WITH {facts._BASE}, s AS (SELECT candidate_id AS c, lower(trim({facts._NAME('name')})) AS n FROM ({facts._items('skills')}) WHERE trim({facts._NAME('name')}) <> ''),
    d AS (SELECT candidate_id AS c, coalesce(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END, {facts._str('e', 'level')}, 'other') AS level FROM ({facts._items('education')})),
    m AS (SELECT candidate_id AS c, avg(CASE WHEN json_type(e, '$.months') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(e, '$.months')::DOUBLE END) AS months FROM ({facts._items('experience')}) GROUP BY 1),
    h AS (SELECT c, count(DISTINCT w) AS hits FROM s JOIN (SELECT unnest({facts._REQUIRED}) AS w) ON contains(n, w) OR contains(w, n) GROUP BY 1),
    k AS (SELECT candidate_id AS c, count(DISTINCT lower(trim({facts._NAME('name')}))) AS n FROM ({facts._items('certifications')}) WHERE trim({facts._NAME('name')}) <> '' GROUP BY 1), g AS (SELECT c, max({facts._POINTS_SQL})::DOUBLE AS p FROM d GROUP BY 1),
    y AS (SELECT candidate_id AS c, greatest(max({facts._YEARS}), CASE WHEN max({facts._YEARS}) IS NOT NULL THEN 0.0 END) AS years FROM a WHERE candidate_id IS NOT NULL GROUP BY 1),
    t AS (SELECT c AS candidate_id, floor(round(CASE WHEN years IS NULL THEN 5.0 ELSE greatest(0.0, least(1.0, years / 8)) * 10 END * 250 / 90 + coalesce(hits, 0) * 10.0 / 3 * 300 / 90 + coalesce(p, 0) * 150 / 90
      + CASE WHEN months IS NULL THEN 5.0 ELSE greatest(0.0, least(1.0, (months - 6) / 18)) * 10 END * 100 / 90 + least(coalesce(k.n, 0) * 2.0, 10.0) * 100 / 90, 9) * 10 + 0.5) / 10 AS total
      FROM y LEFT JOIN h USING (c) LEFT JOIN g USING (c) LEFT JOIN m USING (c) LEFT JOIN k USING (c)),
    r AS (SELECT t.*, j.job_id FROM t JOIN (SELECT candidate_id, min(job_id) AS job_id FROM candidates GROUP BY 1) j USING (candidate_id))"""


@query(f"{_RESCORED} SELECT candidate_id, job_id, total, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank, count(*) OVER (PARTITION BY job_id) AS n FROM r")
def rescored(spark, sf):
    """Candidates scored by all their kept answers and ranked within their job."""
    s = rescore(facts._answers(spark, sf), "candidate_id", facts._REQUIRED, facts._EDU)
    jobs = table(spark, sf, "candidates").groupBy("candidate_id").agg(F.min("job_id").alias("job_id"))
    return scoring.ranked(s.join(jobs, "candidate_id"), "job_id", [F.desc("total"), F.asc("candidate_id")]).select("candidate_id", "job_id", "total", "rank", "n")


@query(
    f"""{_RESCORED}, i AS (SELECT candidate_id, bool_or(coalesce(len(identity_info.emails), 0) > 0) AS c FROM extractions GROUP BY 1), q AS (SELECT r.*, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank, i.c FROM r LEFT JOIN i USING (candidate_id))
    SELECT candidate_id, job_id, rank, row_number() OVER (PARTITION BY job_id ORDER BY rank) AS place FROM q WHERE coalesce(c, true)"""
)
def displayed_ranks(spark, sf):
    """Ranks of those with a known address, renumbered among them."""
    i = table(spark, sf, "extractions").groupBy("candidate_id").agg(F.bool_or(F.coalesce(F.size("identity_info.emails"), F.lit(0)) > 0).alias("is_candidate"))
    return reports.displayed(rescored(spark, sf).join(i, "candidate_id", "left"), "job_id").select("candidate_id", "job_id", "rank", "place")


def _word(text: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>".encode("utf-8", "replace"))
    return out.getvalue()


def _page(text: str) -> bytes:
    strings = b" ".join(b"(\xfe\xff" + line.encode("utf-16-be", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b") Tj" for line in text.split("\n"))
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\n" + zlib.compress(strings, 1) + b"\nendstream endobj"


#: What XML can't hold, and what the parsers take for unseen.
_PLAIN = r"^[\x{09}\x{0A}\x{20}-\x{7E}\x{A1}-\x{AC}\x{AE}-\x{17F}\x{400}-\x{45F}\x{490}\x{491}]*\z"


def _made(spark, sf, make, suffix: str) -> DataFrame:
    """Files made of the texts of documents, for the round trip through a reader."""
    d = table(spark, sf, "documents").where((F.length("text") > 0) & F.col("text").rlike(_PLAIN)).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"{i}.{suffix}" for i in b["doc_id"]], "content": [make(t) for t in b["text"]]})

    return spread(d).mapInPandas(run, "path string, content binary")


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^[\s]+', ''), '[\s]+$', '')), lambda l: l <> '')"


@query(rf"SELECT doc_id, true AS ok, md5(array_to_string({_LINES}, chr(10))) AS visible, 0::BIGINT AS n_hidden FROM documents WHERE length(text) > 0 AND regexp_full_match(text, '{_PLAIN[1:-2]}')")
def word_round_trip(spark, sf):
    """Texts written as word processing documents and read back: a line a paragraph, none of it hidden."""
    got = dispatch.scan(_made(spark, sf, _word, "docx"))
    return got.select(F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), "ok", F.md5("visible").alias("visible"), F.length("hidden").cast("long").alias("n_hidden"))


@query(rf"SELECT doc_id, true AS ok, md5(array_to_string(string_split(text, chr(10)), ' ')) AS visible FROM documents WHERE length(text) > 0 AND trim(text, ' ' || chr(10) || chr(9)) <> '' AND regexp_full_match(text, '{_PLAIN[1:-2]}')")
def page_round_trip(spark, sf):
    """Texts written as page documents and read back."""
    got = dispatch.scan(_made(spark, sf, _page, "pdf")).where("trim(BOTH '\n\t ' FROM visible) <> ''")
    return got.select(F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), "ok", F.md5("visible").alias("visible"))


@query(rf"SELECT scan_id, contains(lower(strip_accents(visible_text)), 'sql') AS in_visible, contains(lower(strip_accents(hidden_text)), 'sql') AS in_hidden FROM {screening._S} WHERE regexp_full_match(visible_text || hidden_text, '{_PLAIN[1:-2]}')")
def payload_places(spark, sf):
    """Whether a word stands in what a model gets and in what is held back, of scans with both in ordinary letters."""
    s = screening._scans(spark, sf, "visible_text", "hidden_text").where(F.concat("visible_text", "hidden_text").rlike(_PLAIN))
    return s.select("scan_id", findings.reaches(F.col("visible_text"), F.col("hidden_text"), F.lit("SQL")).alias("r")).select("scan_id", "r.*")


def _streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream over what is there now gives, written and read again under the shared folder."""
    import uuid

    at = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_once(spark, sf):
    """Each user of the event stream once, however often they come."""
    s = ingest.parquet_stream(spark, f"{sf}/events.parquet*", _EVENTS).where("user_id IS NOT NULL")
    return _streamed(spark, ingest.once(s, "user_id", "ts", "3650 days").select("user_id"), "once")


@query("WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_windows(spark, sf):
    """Events by hour and kind, of the hours that the watermark has passed."""
    s = ingest.parquet_stream(spark, f"{sf}/events.parquet*", _EVENTS)
    return _streamed(spark, ingest.windowed_counts(s, "ts", "event_type"), "windows")
