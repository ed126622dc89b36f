"""What a reader can see: cascades over text runs and page spans.

Both cascades are CASE expressions, first match wins; nothing is shuffled but in the two spatial joins, which meet on
the page before they compare boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, text
from .findings import CLIP, escalate, instruction

#: Contrast below which text is hidden or faint, and sizes in points below which it is too small to read.
HIDDEN_CONTRAST, FAINT_CONTRAST, TINY_POINTS = 1.6, 2.5, 4.0
OVERLAP = 0.5
#: Characters that an annotation must have to be a finding, text that lies off a page, and unseen ones.
LEAST_TEXT, LEAST_EVIDENCE = 12, 150
HIDDEN_STATES = ("vanish", "low_contrast", "tiny_font")
FINDINGS = "type string, severity string, location string, evidence string, method string"


def background(highlight: Column, run: Column, paragraph: Column, page: Column) -> Column:
    """The colour behind a run: highlight, run shading, paragraph shading, page, white."""
    return F.coalesce(color.parse(highlight), color.parse(run), color.parse(paragraph), color.parse(page), F.lit("FFFFFF"))


def foreground(own: Column, behind: Column) -> Column:
    """The run's colour; an automatic one is black on light and white on dark."""
    return F.coalesce(color.parse(own), F.when(color.luminance(behind) > 0.5, "000000").otherwise("FFFFFF"))


def vanishes(v: Column, present: Column) -> Column:
    """A vanish mark that is not switched off; unknown values hide."""
    return F.coalesce(present & ~F.lower(F.coalesce(v, F.lit("true"))).isin("false", "0", "off"), F.lit(False))


def classify_runs(runs: DataFrame) -> DataFrame:
    """Adds contrast, state, hidden, n_unseen, clean (the text without unseen characters and white space around it) and tags
    (what tag characters spell) to runs.

    runs: text, vanish, has_vanish, color, highlight, run_shd, para_shd, doc_bg, size_half_pt and perhaps kind. The state
    of a run of text is empty, vanish, low_contrast, tiny_font, faint or visible, the first that fits. Of the other kinds
    (annotation, alt_text, metadata) it is the kind itself: a reader of the page sees none of them, so none is ever
    visible. Null sizes are read as readable, null texts as empty, null kinds as text.
    """
    r = runs if "kind" in runs.columns else runs.withColumn("kind", F.lit("text"))
    r = r.withColumn("__back", background(F.col("highlight"), F.col("run_shd"), F.col("para_shd"), F.col("doc_bg"))).withColumn("__below", color.luminance(F.col("__back")))
    r = r.withColumn("__own", color.luminance(F.coalesce(color.parse(F.col("color")), F.when(F.col("__below") > 0.5, "000000").otherwise("FFFFFF"))))
    r = r.withColumn("contrast", F.round((F.greatest("__own", "__below") + 0.05) / (F.least("__own", "__below") + 0.05), 3))
    r = r.withColumn("n_unseen", F.coalesce(text.invisible_count(F.col("text")), F.lit(0))).withColumn("clean", text.trimmed(text.strip_invisible(F.coalesce("text", F.lit("")))))
    r = r.withColumn("tags", F.when(F.col("n_unseen") > 0, text.decode_tags(F.col("text"))).otherwise(F.lit("")))
    state = (
        F.when(F.coalesce("kind", F.lit("text")) != "text", F.col("kind"))
        .when(F.col("clean") == "", "empty")
        .when(vanishes(F.col("vanish"), F.col("has_vanish")), "vanish")
        .when(F.col("contrast") < HIDDEN_CONTRAST, "low_contrast")
        .when(F.coalesce(F.col("size_half_pt") / 2 < TINY_POINTS, F.lit(False)), "tiny_font")
        .when(F.col("contrast") < FAINT_CONTRAST, "faint")
        .otherwise("visible")
    )
    return r.withColumn("state", state).withColumn("hidden", F.col("state").isin(*HIDDEN_STATES)).drop("__back", "__below", "__own")


def evidence(hit: Column, c: Column) -> Column:
    """The text's beginning, after what was matched in it."""
    return F.concat(F.when(F.coalesce(hit, F.lit("")) != "", F.concat(F.lit("[match: "), hit, F.lit("] "))).otherwise(""), F.substring(F.coalesce(c, F.lit("")), 1, CLIP))


def _finding(kind: Column, severity: Column, location: Column, what: Column) -> Column:
    return F.struct(kind.alias("type"), severity.alias("severity"), location.alias("location"), what.alias("evidence"), F.lit("deterministic").alias("method"))


def scanned(classified: DataFrame, key: str = "doc") -> DataFrame:
    """(key, visible, hidden, findings) of every document that has runs, in one pass over them.

    Visible are only runs of text that the cascade leaves visible or faint, without unseen characters, joined by spaces
    within a paragraph, paragraphs by line feeds; the body first, then the other parts by name. Hidden, a line each, are
    the hidden runs, what tag characters spell, annotations of at least ``LEAST_TEXT`` characters (by part), and
    alternative texts (each) and metadata (by part) with an instruction. Findings (``FINDINGS``) are those, unseen
    characters (at least three) and faint runs. An instruction makes a finding critical, but a faint text stays info.
    A group is one part of one document, whose size the reader limits.
    """
    state, faint, alt = F.col("state"), F.col("state") == "faint", F.col("state") == "alt_text"
    text_run = state.isin("empty", "faint", "visible", *HIDDEN_STATES)
    r = classified.withColumn("hit", instruction(F.when(F.col("hidden") | faint | alt, F.col("clean")), broad=True)).withColumn("tag_hit", instruction(F.when(F.col("tags") != "", F.col("tags")), broad=True))
    alt_hit = alt & (F.coalesce("hit", F.lit("")) != "")
    spelled = F.substring(F.when(F.col("tags") != "", F.col("tags")).otherwise(F.concat(F.col("n_unseen").cast("string"), F.lit(" invisible code points"))), 1, LEAST_EVIDENCE)
    unseen = F.when(text_run & (F.col("n_unseen") >= text.INVISIBLE_LEAST), _finding(F.lit("unicode_invisible"), escalate(F.lit("warn"), F.col("tag_hit")), F.col("part"), spelled))
    kind = F.when(faint, "docx_faint_text").otherwise(F.concat(F.lit("docx_"), state))
    odd = F.when(
        faint | F.col("hidden") | alt_hit, _finding(kind, F.when(faint, "info").otherwise(escalate(F.lit("warn"), F.col("hit"))), F.col("part"), F.when(faint, F.substring("clean", 1, CLIP)).otherwise(evidence(F.col("hit"), F.col("clean"))))
    )
    tag_line = F.when(text_run & (F.col("tags") != ""), F.col("tags"))
    row = F.struct(
        "para", "run", F.when(state.isin("visible", "faint"), F.col("clean")).alias("shown"), F.array_compact(F.array(tag_line, F.when(F.col("hidden") | alt_hit, F.col("clean")))).alias("lines"),
        F.array_compact(F.array(unseen, odd)).alias("found"), F.when(state == "annotation", F.col("text")).alias("note"), F.when(state == "metadata", F.col("clean")).alias("meta"), F.when(~text_run & ~alt, state).alias("kind"),
    )
    x = r.groupBy(key, "part").agg(F.array_sort(F.collect_list(row)).alias("x"))
    each = lambda c, f: F.transform(F.filter("x", lambda v: v[c].isNotNull()), f)
    noted = F.concat(F.array_join(each("note", lambda v: v["note"]), ""), F.array_join(each("meta", lambda v: v["meta"]), " "))
    x = x.withColumn("kind", F.array_max(F.transform("x", lambda v: v["kind"]))).withColumn("other", F.when(F.col("kind").isNotNull(), text.trimmed(text.strip_invisible(noted))))
    x = x.withColumn("hit", instruction(F.col("other"), broad=True)).withColumn("kept", F.coalesce(F.when(F.col("kind") == "metadata", F.col("hit") != "").otherwise(F.length("other") >= LEAST_TEXT), F.lit(False)))
    x = x.withColumn("seen", F.filter("x", lambda v: v["shown"].isNotNull()))
    before = lambda i: F.get("seen", i - 1)["para"]
    visible = F.array_join(F.transform("seen", lambda v, i: F.concat(F.when(i == 0, "").when(before(i) == v["para"], " ").otherwise("\n"), v["shown"])), "")
    lines = F.concat(F.flatten(F.transform("x", lambda v: v["lines"])), F.array_compact(F.array(F.when(F.col("kept"), F.col("other")))))
    whole = F.when(F.col("kept"), _finding(F.concat(F.lit("docx_"), F.col("kind")), escalate(F.lit("info"), F.col("hit")), F.col("part"), evidence(F.col("hit"), F.col("other"))))
    found = F.concat(F.flatten(F.transform("x", lambda v: v["found"])), F.array_compact(F.array(whole)))
    step = F.when(F.col("kind") == "metadata", 3).when(F.col("kind").isNotNull(), 2).when(F.col("part").rlike("(^|/)document(.xml)?$"), 0).otherwise(1)
    parts = x.select(key, F.struct(step.alias("step"), "part", visible.alias("v"), F.array_join(lines, "\n").alias("h"), found.alias("f")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    of = lambda c: F.array_join(F.transform(F.filter("p", lambda v: v[c] != ""), lambda v: v[c]), "\n")
    return parts.select(key, of("v").alias("visible"), of("h").alias("hidden"), F.flatten(F.transform("p", lambda v: v["f"])).alias("findings"))


def docx_findings(classified: DataFrame, key: str = "doc") -> DataFrame:
    """(key, ``FINDINGS``): a row per finding of word processing documents; documents without any have none."""
    return scanned(classified, key).select(key, F.explode("findings").alias("f")).select(key, "f.*")


def assemble(classified: DataFrame, key: str = "doc") -> DataFrame:
    """(key, visible, hidden): the texts that a reader sees and doesn't. Documents without any run have no row."""
    return scanned(classified, key).select(key, "visible", "hidden")


def grade(contrast: Column, points: Column) -> Column:
    """The same cascade for measured contrast and size."""
    return F.when(contrast < HIDDEN_CONTRAST, "low_contrast").when(points < TINY_POINTS, "tiny_font").when(contrast < FAINT_CONTRAST, "faint").otherwise("visible")


def behind_spans(spans: DataFrame, drawings: DataFrame) -> DataFrame:
    """Adds fill to page spans: that of the smallest drawing on the page that contains the span, white without one; of
    equal areas the later drawing."""
    s, d = spans.alias("s"), drawings.alias("d")
    inside = (F.col("d.x0") <= F.col("s.x0")) & (F.col("d.y0") <= F.col("s.y0")) & (F.col("d.x1") >= F.col("s.x1")) & (F.col("d.y1") >= F.col("s.y1"))
    met = s.join(d, (F.col("s.doc") == F.col("d.doc")) & (F.col("s.page") == F.col("d.page")) & inside, "left")
    area = (F.col("d.x1") - F.col("d.x0")) * (F.col("d.y1") - F.col("d.y0"))
    keys = [F.col(f"s.{c}").alias(c) for c in spans.columns]
    return met.groupBy(*keys).agg(F.coalesce(F.min_by("d.fill", F.struct(area, -F.col("d.ord"))), F.lit("FFFFFF")).alias("fill"))


def under_invisible(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """The spans of which more than half lies in an unseen region of their page."""
    s, d = spans.alias("s"), regions.alias("d")
    w = F.least(F.col("s.x1"), F.col("d.x1")) - F.greatest(F.col("s.x0"), F.col("d.x0"))
    h = F.least(F.col("s.y1"), F.col("d.y1")) - F.greatest(F.col("s.y0"), F.col("d.y0"))
    over = (w > 0) & (h > 0) & (w * h > OVERLAP * (F.col("s.x1") - F.col("s.x0")) * (F.col("s.y1") - F.col("s.y0")))
    return s.join(d, (F.col("s.doc") == F.col("d.doc")) & (F.col("s.page") == F.col("d.page")) & over, "left_semi")


def classify_spans(spans: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Adds state to page spans that have fill, ink and in_region: invisible region, off the page (one unit of slack),
    then contrast and size as for runs."""
    off = (F.col("x1") < -1) | (F.col("y1") < -1) | (F.col("x0") > width + 1) | (F.col("y0") > height + 1)
    c = F.round(color.contrast(F.col("ink"), F.col("fill")), 3)
    return spans.withColumn("state", F.when(F.col("in_region"), "invisible_region").when(off, "offpage").otherwise(grade(c, F.col("size"))))


def remapped(fonts: DataFrame, least: int = 3) -> DataFrame:
    """Fonts whose character map gives at least ``least`` printable ASCII codes another character, with the text it spells
    in the order of the codes; embedded fonts don't count."""
    odd = F.map_filter("cmap", lambda k, v: k.between(33, 126) & (F.chr(k) != v) & (F.length(v) > 0))
    payload = F.array_join(F.transform(F.array_sort(F.map_entries(odd)), lambda e: e["value"]), "")
    return fonts.where(~F.col("embedded")).withColumn("n_remapped", F.size(odd)).withColumn("payload", payload).where(F.col("n_remapped") >= least)


def without_payload(texts: DataFrame, fonts: DataFrame, key: str = "doc", visible: str = "visible") -> DataFrame:
    """(key, visible, hidden): each document's visible text without the first place of what its ``remapped`` fonts spell,
    which is hidden; of several the longest. Documents without such fonts stay as they are, hidden null."""
    spelled = fonts.groupBy(key).agg(F.max_by("payload", F.struct(F.length("payload"), "payload")).alias("hidden"))
    at, size = F.position(F.col("hidden"), F.col(visible)), F.length("hidden")
    rest = F.concat(F.substr(F.col(visible), F.lit(1), at - 1), F.substr(F.col(visible), at + size))
    return texts.join(spelled, key, "left").select(key, F.when(at > 0, rest).otherwise(F.col(visible)).alias("visible"), "hidden")


def classify_trace(trace: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Adds state to the drawing trace of pages (x0, y0, x1, y1, type, opacity): offpage where a piece lies wholly outside
    the page, invisible_region for unpainted and clipping text (types 3 and 7) and for opacity of at most 0.05, else null."""
    off = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x0") > width) | (F.col("y0") > height)
    return trace.withColumn("state", F.when(off, "offpage").when(F.col("type").isin(3, 7) | (F.col("opacity") <= 0.05), "invisible_region"))


#: The finding of each state of a span.
SPAN_FINDINGS = {"invisible_region": "pdf_render_mode_3", "offpage": "pdf_offpage", "low_contrast": "pdf_low_contrast", "tiny_font": "pdf_tiny_font", "faint": "pdf_faint_text"}


def _page(c: str) -> Column:
    return F.concat(F.lit("page "), F.col(c).cast("string"))


def pdf_findings(spans: DataFrame, trace: DataFrame, forms: DataFrame, fonts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, ``FINDINGS``) of page documents: spans that the cascade hides or finds faint, traced pieces off the page of at
    least ``LEAST_TEXT`` characters, forms and remapped fonts. An instruction makes all but the faint critical.

    spans: those of ``classify_spans``; trace: those of ``classify_trace``; forms: (key, form, has_form); fonts: those of
    ``remapped``. Empty texts have none.
    """
    s = spans.where((F.col("state") != "visible") & (text.trimmed(F.col("text")) != "")).withColumn("t", text.trimmed(F.col("text")))
    names = F.create_map(*[F.lit(x) for kv in SPAN_FINDINGS.items() for x in kv])
    parts = [
        s.select(key, names[F.col("state")].alias("type"), F.when(F.col("state") == "faint", "info").otherwise("warn").alias("base"), _page("page").alias("location"), "t"),
        trace.where((F.col("state") == "offpage") & (F.length(text.trimmed(F.col("text"))) >= LEAST_TEXT)).select(key, F.lit("pdf_offpage").alias("type"), F.lit("warn").alias("base"), _page("page").alias("location"), text.trimmed(F.col("text")).alias("t")),
        forms.where("has_form").select(key, F.lit("pdf_xfa").alias("type"), F.lit("warn").alias("base"), F.lit("form").alias("location"), F.coalesce("form", F.lit("")).alias("t")),
        fonts.select(key, F.lit("pdf_tounicode_mismatch").alias("type"), F.lit("warn").alias("base"), F.concat(F.lit("font "), F.col("font").cast("string")).alias("location"), F.col("payload").alias("t")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.withColumn("hit", instruction(F.col("t"), broad=True))
    base = F.col("base") == "info"
    return whole.select(key, "type", F.when(base, "info").otherwise(escalate(F.col("base"), F.col("hit"))).alias("severity"), "location", F.when(base, F.substring("t", 1, CLIP)).otherwise(evidence(F.col("hit"), F.col("t"))).alias("evidence"), F.lit("deterministic").alias("method"))


def pdf_texts(spans: DataFrame, forms: DataFrame, key: str = "doc") -> DataFrame:
    """(key, visible, hidden) of page documents: spans in the order of pages, joined by spaces, pages by line feeds; forms
    of at least ``LEAST_TEXT`` characters are hidden."""
    s = spans.withColumn("t", text.trimmed(F.coalesce("text", F.lit("")))).where("t <> ''")
    line = lambda seen: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("state").isin("visible", "faint") == seen, F.struct("ord", "t")))), lambda v: v["t"]), " ")
    pages = s.groupBy(key, "page").agg(line(True).alias("v"), line(False).alias("h"))
    form = forms.where(F.length("form") >= LEAST_TEXT).select(key, F.lit(1 << 30).alias("page"), F.lit("").alias("v"), F.col("form").alias("h"))
    of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("page", F.col(c).alias("t"))))), lambda v: v["t"]), "\n")
    return pages.unionByName(form).groupBy(key).agg(of("v").alias("visible"), of("h").alias("hidden"))


def visible_tone(texts: DataFrame, key: str = "doc", visible: str = "visible") -> DataFrame:
    """(key, ``FINDINGS``): a warning for every visible text that addresses a program or praises its author as an
    instruction would, with the place; it stays visible."""
    hit = texts.withColumn("hit", instruction(F.col(visible), broad=True)).where("hit <> ''")
    return hit.select(key, F.lit("visible_instruction_tone").alias("type"), F.lit("warn").alias("severity"), F.lit("visible text").alias("location"), F.concat(F.lit("[match: "), F.col("hit"), F.lit("]")).alias("evidence"), F.lit("deterministic").alias("method"))


def near_white(rgb: Column) -> Column:
    """The simpler test of a first detector: all three channels of six hexadecimal digits at least F0."""
    return F.coalesce(color.parse(rgb), F.lit("000000")).rlike("^(?:F.){3}$")
