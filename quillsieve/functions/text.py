"""Scalar text functions as column expressions; lengths and places count code points."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that cannot be seen, as a Java class body.
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}"
#: Characters that cannot be seen beside those of Unicode's category Cf: variation selectors and the combining joiner.
_SELECTORS = {"\u034f", "\u180b", "\u180c", "\u180d", *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0000, 0xE0080))}
#: Findings start at so many unseen characters.
INVISIBLE_LEAST = 3
#: Accented Latin letters and their plain forms, position by position.
ACCENTED = "áàâäãåąčçćďđéèêëěęíìîïĺľłňñńóòôöõőøŕřšśşťţúùûüůűýÿžźż"
PLAIN = "aaaaaaacccddeeeeeeiiiilllnnnooooooorrsssttuuuuuuyyzzz"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ./()-]{7,18}[0-9]"
_SPACE = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"


def fold(c: Column) -> Column:
    """Small letters without accents, white space runs as one space, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), _SPACE, " "))


def _unmask(t: str | None) -> str | None:
    if t is None or t.isascii():
        return t
    seen = "".join([ch for ch in t if unicodedata.category(ch) != "Cf" and ch not in _SELECTORS])
    return "".join([ch for ch in unicodedata.normalize("NFKD", seen) if not unicodedata.combining(ch)])


def unmask(c: Column) -> Column:
    """The text without characters that cannot be seen and without combining marks, and
    compatibility forms (full width, mathematical letters, ligatures) as what they stand for. Null stays null."""

    def texts(batch: pa.Array) -> pa.Array:
        return pa.array([_unmask(t) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(c)


def unmask_each(c: Column) -> Column:
    """``unmask`` of each of a list of texts."""

    def lists(batch: pa.Array) -> pa.Array:
        return pa.array([None if ts is None else [_unmask(t) for t in ts] for ts in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(lists, "array<string>")(c)


#: Control characters that stand for a letter where a single-byte encoding was taken for another.
_CONTROLS = {0x8A: "s", 0x9A: "s", 0x8C: "s", 0x9C: "s", 0x8E: "z", 0x9E: "z", 0x9F: "y"}


def _decomposed(batch: pa.Array, form) -> pa.Array:
    return pa.array([None if t is None else form(t if t.isascii() else "".join([ch for ch in unicodedata.normalize("NFKD", t) if not "\u0300" <= ch <= "\u036f"])) for t in batch.to_pylist()], pa.string())


def norm(c: Column) -> Column:
    """Compatibility forms decomposed, accents dropped, small letters, none of the white space at the ends."""
    return F.trim(F.lower(F.arrow_udf(lambda b: _decomposed(b, str.strip), "string")(c)))


def norm_name(c: Column) -> Column:
    """``norm`` with white space runs as one space."""
    return F.arrow_udf(lambda b: _decomposed(b, lambda t: " ".join(t.lower().split())), "string")(c)


def fold_controls(c: Column) -> Column:
    """``norm`` for text with controls: those that stand for a letter are it, others spaces; white space runs as one."""
    table = {o: _CONTROLS.get(o, " ") for o in range(0x80, 0xA0)}
    return F.arrow_udf(lambda b: _decomposed(b, lambda t: re.sub(r"\s+", " ", t.translate(table)).lower()), "string")(c)


def strip_markdown_head(c: Column) -> Column:
    """A converter's text without the heading that names the file and the list of metadata after it."""
    t = F.regexp_replace(F.regexp_replace(c, r"^\x{FEFF}", ""), r"^#[^\n]*\n+", "")
    return trimmed(F.regexp_replace(t, r"(?i)^##[ \t]*Metadata[ \t]*\n(?:[ \t]*-[^\n]*\n?)*", ""))


def invisible_count(c: Column) -> Column:
    """How many characters can't be seen; 0 for an empty text."""
    return F.length(c) - F.length(strip_invisible(c))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def decode_tags(c: Column) -> Column:
    """The ASCII text that tag characters (U+E0020 to U+E007E) spell; empty where there are none."""
    chars = F.regexp_extract_all(c, F.lit(r"[\x{E0020}-\x{E007E}]"), F.lit(0))
    return F.array_join(F.transform(chars, lambda ch: F.chr(F.ascii(ch) - F.lit(0xE0000))), "")


def emails(c: Column) -> Column:
    """Addresses in the order of the text, small letters, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), F.lower))


def phones(c: Column) -> Column:
    """Digits of phone-like runs of 9 to 15 digits, in order, each once."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.array_distinct(F.filter(runs, lambda p: F.length(p).between(9, 15)))


def strip_markup(c: Column) -> Column:
    """Without tags; white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), _SPACE, " "))


#: Words of document names that don't name a person, folded.
DOCUMENT_WORDS = "cv|resume|curriculum|vitae|zivotopis|lebenslauf|motivacni|dopis|motivation|letter|cover|anschreiben|certificate|certifikat|zeugnis|diplom|diploma|priloha|anlage|annex|final|kopie|copy|scan|inzerat|stellenanzeige|job|ad"


def person_key(name: Column) -> Column:
    """The person that a document name speaks of: without extension, document words, versions and years, folded first so
    that accented document words go too; the folded name itself where nothing is left."""
    base = fold(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), "[_+-]", " "))
    words = F.filter(F.split(base, " "), lambda w: ~w.rlike(f"^(?:{DOCUMENT_WORDS}|v[0-9]+|[0-9]+|)$"))
    key = F.array_join(words, " ")
    return F.when(key != "", key).otherwise(fold(name))


def extension(name: Column) -> Column:
    """The last extension in small letters, empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def snippet(text: Column, word: Column, around: int = 45) -> Column:
    """The first occurrence of a word, whatever its case, with ``around`` characters on both sides, white space runs as one
    space, and an ellipsis where text is cut; null without an occurrence."""
    at = F.position(F.lower(word), F.lower(text))
    start = F.greatest(at - F.lit(around), F.lit(1))
    size = at - start + F.length(word) + F.lit(around)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.regexp_replace(F.substr(text, start, size), _SPACE, " ")), F.when(start + size <= F.length(text), "…").otherwise(""))
    return F.when((at > 0) & (F.length(word) > 0), cut)


#: Types of documents.
DOCUMENT_TYPES = ("cv", "cover_letter", "job_posting", "other", "certificate", "diploma", "reference", "job_ad", "portfolio")


def document_type(raw: Column) -> Column:
    """One of ``DOCUMENT_TYPES`` in whatever spelling; anything else is a cv, so no applicant is hidden."""
    t = F.regexp_replace(F.lower(F.trim(raw)), "[ -]+", "_")
    return F.when(t.isin(*DOCUMENT_TYPES), t).otherwise(F.lit("cv"))
