"""Files of all kinds scanned into one table: each goes to the reader of its extension, and none fails the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut
from ..functions.text import extension, strip_markdown_head
from ..operators import findings, visibility
from . import docx, pdf

#: Extensions by reader.
READERS = {"docx": ("docx",), "pdf": ("pdf",), "text": ("txt", "md"), "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff")}
SCANNED = ("path", "reader", "visible", "hidden", "findings", "ok", "error", "note")
_NONE = "CAST(array() AS array<struct<type:string,severity:string,location:string,evidence:string,method:string>>)"


def reader_of(ext: Column) -> Column:
    """docx, pdf, text, image or unsupported."""
    out = None
    for name, exts in READERS.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("unsupported")


def preferred(converted: Column, raw: Column) -> Column:
    """A converter's text without its heading and metadata, the raw text where that is empty."""
    return F.coalesce(F.nullif(strip_markdown_head(converted), F.lit("")), raw)


def instruction_place(converted: Column, raw: Column) -> Column:
    """Where an instruction stands: searched in the converter's text first, then in the raw one; null without any."""
    found = lambda c: F.when(F.coalesce(findings.instruction(c), F.lit("")) != "", findings.context(c))
    return F.coalesce(found(converted), found(raw))


def _finding(kind: str, severity: str, what: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit("document").alias("location"), what.alias("evidence"), F.lit("deterministic").alias("method"))


def _shape(df: DataFrame, reader: str) -> DataFrame:
    return df.withColumn("reader", F.lit(reader)).select(*SCANNED)


def scan(files: DataFrame, images: Callable[[DataFrame], DataFrame] | None = None, converted: DataFrame | None = None) -> DataFrame:
    """(``SCANNED``): a row per file (path, content).

    Word processing documents and pages are read by their parsers, plain text is decoded, images go to ``images`` (path,
    content to path, text) if it is given. converted: (path, converted), another converter's text of pages, preferred to
    the raw one. Files that can't be read have ok false and an error, kinds without a reader a note. Images and pages
    without text need character recognition, an info. Visible instructions warn and stay visible.
    """
    f = files.select("path", "content").withColumn("reader", reader_of(extension(F.col("path"))))
    runs = docx.read(f.where("reader = 'docx'"))
    runs = cut(runs)  # parsed once, read for texts and for errors
    bad = runs.where("NOT ok").select(F.col("doc").alias("path"), "error").distinct()
    whole = visibility.scanned(visibility.classify_runs(runs.where("ok")))
    every = f.where("reader = 'docx'").select("path").distinct().join(whole.withColumnRenamed("doc", "path"), "path", "left").join(bad, "path", "left")
    word = every.select("path", F.coalesce("visible", F.lit("")).alias("visible"), F.coalesce("hidden", F.lit("")).alias("hidden"), F.coalesce("findings", F.expr(_NONE)).alias("findings"), F.col("error").isNull().alias("ok"), "error", F.lit(None).cast("string").alias("note"))
    pages = pdf.read(f.where("reader = 'pdf'")).withColumnRenamed("doc", "path")
    pages = pages.join(converted.select("path", "converted"), "path", "left") if converted is not None else pages.withColumn("converted", F.lit(None).cast("string"))
    pages = pages.withColumn("visible", F.coalesce(preferred(F.col("converted"), F.col("text")), F.lit(""))).withColumn("place", instruction_place(F.col("converted"), F.col("text")))
    form_hit = findings.instruction(F.col("form"), broad=True)
    pages = pages.withColumn("form_hit", form_hit)
    xfa = F.struct(F.lit("pdf_xfa").alias("type"), findings.escalate(F.lit("warn"), F.col("form_hit")).alias("severity"), F.lit("form").alias("location"), visibility.evidence(F.col("form_hit"), F.col("form")).alias("evidence"), F.lit("deterministic").alias("method"))
    empty = F.col("ok") & (F.trim("visible") == "")
    page = pages.select(
        "path", "visible", F.when(F.length("form") >= visibility.LEAST_TEXT, F.col("form")).otherwise("").alias("hidden"),
        F.array_compact(F.array(F.when(F.col("place").isNotNull(), _finding("pdf_injection_text", "warn", F.col("place"))), F.when(F.col("has_form"), xfa), F.when(empty, _finding("needs_ocr", "info", F.lit(""))))).alias("findings"),
        "ok", "error", F.lit(None).cast("string").alias("note"),
    )
    plain = f.where("reader = 'text'").withColumn("visible", F.coalesce(F.decode("content", "UTF-8"), F.lit("")))
    seen = images(f.where("reader = 'image'").select("path", "content")) if images else f.where("reader = 'image'").select("path", F.lit(None).cast("string").alias("text"))
    image = seen.select("path", F.coalesce("text", F.lit("")).alias("visible"))
    tone = lambda df: df.withColumn("hit", findings.instruction(F.col("visible"), broad=True))
    warned = F.when(F.coalesce("hit", F.lit("")) != "", _finding("visible_instruction_tone", "warn", F.col("hit")))
    text = tone(plain).select("path", "visible", F.lit("").alias("hidden"), F.array_compact(F.array(warned)).alias("findings"), F.col("content").isNotNull().alias("ok"), F.when(F.col("content").isNull(), "no content").alias("error"), F.lit(None).cast("string").alias("note"))
    ocr = F.when(F.trim("visible") == "", _finding("needs_ocr", "info", F.lit("")))
    picture = tone(image).select("path", "visible", F.lit("").alias("hidden"), F.array_compact(F.array(warned, ocr)).alias("findings"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("note"))
    other = f.where("reader = 'unsupported'").select("path", F.lit("").alias("visible"), F.lit("").alias("hidden"), F.expr(f"{_NONE} AS findings"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit("unsupported kind of file").alias("note"))
    out = _shape(word, "docx")
    for df, name in ((page, "pdf"), (text, "text"), (picture, "image"), (other, "unsupported")):
        out = out.unionByName(_shape(df, name))
    return out


#: Schema of a batch of documents that come as text or with a kept extraction.
BATCH = "files array<struct<name:string,visible:string,cached:string>>, requirements string"


def json_batch(lines: DataFrame, raw: str = "value") -> DataFrame:
    """(batch, ord, name, visible, cached): the documents of JSON batches in order; unreadable lines have none."""
    b = lines.select(F.from_json(raw, BATCH).alias("b"), F.xxhash64(raw).alias("batch"))
    return b.select("batch", F.posexplode("b.files").alias("ord", "f")).select("batch", "ord", "f.*")


def one_batch(fresh: DataFrame, cached: DataFrame, order: str = "ord") -> DataFrame:
    """Fresh files before cached ones, each in its order: adds place (step, ord) to the union; columns that one side lacks
    are null there."""
    step = lambda df, n: df.withColumn("place", F.struct(F.lit(n).alias("step"), F.col(order).alias("ord")))
    return step(fresh, 0).unionByName(step(cached, 1), allowMissingColumns=True)
