"""Texts that look alike made alike.

A text is cut at plain white space; the pieces with a character that may stand in for another are its values. Over the
distinct values only, each is mapped to its look-alike form; SQL groups the mapped forms under the accent-sensitive
collation UNICODE, so canonically equal spellings fall together and different accents don't, chooses one canonical
member per class, and joins it back to the texts that hold another member.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, join_counted, spread
from .damage import Repairer, repairer_for
from .glyphs import FOREIGN, INVISIBLE, SIGNS, SPACES, TO_CYRILLIC, compat

#: The texts of which p1 has cases; hidden texts are none of them.
DECODED = ("visible_text", "evidence")
_CONTROLS = [*range(0, 9), 11, 12, *range(14, 32), 127]


def _cls(points: list[int]) -> str:
    """A Java character class body that holds the code points: runs as ranges, from U+2100 over gaps of up to 64 too.

    Java tries the ranges of a class one by one, so few wide ones are much faster; what they hold beyond the points only
    makes values that turn out canonical.
    """
    points, out = sorted(set(points)), []
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] - points[j] <= (64 if points[j] >= 0x2100 else 1):
            j += 1
        out.append(f"\\x{{{points[i]:X}}}" + (f"-\\x{{{points[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


#: Combining marks, and the scripts and letters that have stand-ins for Latin ones.
_MARKS = "\\x{300}-\\x{36F}\\x{483}-\\x{489}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{FE20}-\\x{FE2F}"
_SCRIPTS = "\\x{131}\\x{251}\\x{261}\\x{370}-\\x{587}\\x{2170}-\\x{217F}"


@lru_cache(maxsize=1)
def any_pattern() -> str:
    """Java pattern of the characters without which a text has no value; one pass over a text, before the pieces are cut."""
    return "[" + _MARKS + _cls([*INVISIBLE, *SPACES, *_CONTROLS, *map(ord, compat()), *map(ord, SIGNS)]) + _SCRIPTS + "]"


_EMOJI = re.compile("[←-⇿⌀-⏿☀-➿⬀-⯿\U0001f000-\U0001faff]")
_UNSEEN = {chr(o) for o in INVISIBLE + _CONTROLS}
_SPACE = {chr(o) for o in SPACES}
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _plain() -> dict[int, str]:
    return {ord(c): to for c, to in (compat() | SIGNS).items()} | {ord(c): " " for c in _SPACE}


def _script(ch: str) -> str:
    o = ord(ch)
    return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "cyrillic" if 0x400 <= o < 0x530 else "other"


def _word(m: re.Match) -> str:
    """A word of two scripts in the one that it is meant in, if all its letters of the other script stand in for such."""
    w = m.group(0)
    latin = [c for c in w if _script(c) == "latin"]
    if not latin or len(latin) == len(w):
        return w
    foreign = [c for c in w if _script(c) != "latin"]
    to_latin = all(c in FOREIGN for c in foreign)
    to_cyrillic = all(c in TO_CYRILLIC for c in latin) and all(_script(c) == "cyrillic" for c in foreign)
    if to_cyrillic and (not to_latin or len(foreign) > len(latin)):
        return "".join([TO_CYRILLIC.get(c, c) for c in w])
    return "".join([FOREIGN.get(c, c) for c in w]) if to_latin else w


def alike(value: str) -> str:
    """The look-alike form: nothing unseen, plain spaces, accents composed, stand-ins as what they stand in for.

    Joiners, selectors and tags inside an emoji stay; words wholly in one script stay as they are.
    """
    if not value.isascii() or any(c in _UNSEEN for c in value):
        kept = []
        for i, c in enumerate(value):
            if c in _UNSEEN or c == "‍":
                before = value[i - 1] if i else ""
                after = value[i + 1 : i + 2]
                emoji = before and (_EMOJI.match(before) or before in "️\U0001f3fb\U0001f3fc\U0001f3fd\U0001f3fe\U0001f3ff‍")
                flag = 0xE0020 <= ord(c) < 0xE0080 and "\U0001f3f4" in value[max(0, i - 7) : i]
                if not (c == "‍" and emoji and after and _EMOJI.match(after) or flag):
                    continue
            kept.append(c)
        value = unicodedata.normalize("NFC", "".join(kept).translate(_plain()))
        value = _LETTERS.sub(_word, value)
    return value


def _texts(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(src, rec_id, text) of the (src, table, key, column) given; rows without key or text are left out."""
    parts = [df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.lit(src).alias("src"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("text")) for src, df, key, text in sources]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@lru_cache(maxsize=1)
def _odd() -> tuple[re.Pattern, re.Pattern]:
    """Characters that make a piece a value, and those without which a text has none."""
    points = sorted({*INVISIBLE, *SPACES, *_CONTROLS, *map(ord, compat()), *map(ord, SIGNS)})
    parts: list[list[int]] = []
    for o in points:
        if parts and parts[-1][1] == o - 1:
            parts[-1][1] = o
        else:
            parts.append([o, o])
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
    return re.compile(f"[{body}]"), re.compile(f"[{body}{_FOREIGN}]")


_FOREIGN = "\u0131\u0251\u0261\u0370-\u0587\u2170-\u217f"
_FOREIGN_LETTER, _LATIN_LETTER = re.compile(f"[{_FOREIGN}]"), re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u024f]")
_PIECE, _CONTROL = re.compile("[^ \t\r\n]+"), re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def pieces(text: str) -> list[str]:
    """A text's distinct values: pieces between plain white space with an odd character, or with letters of two scripts."""
    odd, any_odd = _odd()
    if not (any_odd.search(text) if not text.isascii() else _CONTROL.search(text)):
        return []
    found = dict.fromkeys(_PIECE.findall(text))
    return [p for p in found if (not p.isascii() or _CONTROL.search(p)) and (odd.search(p) or _FOREIGN_LETTER.search(p) and _LATIN_LETTER.search(p))]


def classes(values: DataFrame) -> DataFrame:
    """(value, n, canonical) of the distinct values (columns value, n) that aren't canonical themselves.

    Values whose look-alike forms are equal under the collation UNICODE are one class. Its canonical member is the
    smallest, by code points, of the look-alike forms; every form counts as a member of its class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([alike(v) for v in b.column(0).to_pylist()], pa.string())], ["value", "n", "form"])

    mapped = values.select("value", "n").mapInArrow(run, "value string, n bigint, form string")
    sql = """
        WITH members AS (SELECT value, n, form FROM {mapped}),
             canon AS (SELECT collate(form, 'UNICODE') AS class, min(form) AS canonical FROM members GROUP BY collate(form, 'UNICODE'))
        SELECT m.value, m.n, collate(c.canonical, 'UTF8_BINARY') AS canonical
        FROM members m JOIN canon c ON collate(m.form, 'UNICODE') = c.class
        WHERE m.value <> collate(c.canonical, 'UTF8_BINARY')
    """
    return values.sparkSession.sql(sql, mapped=mapped)


def variants(sources: list[tuple[str, DataFrame, str, str]], decoder: Repairer | None = None) -> DataFrame:
    """(src, rec_id, value, canonical): every text's values that aren't the canonical member of their class.

    With ``decoder`` the texts of ``DECODED`` that it finds damaged by a wrong decoding are left out: their characters
    aren't stand-ins. Repeated rows count once; null and empty texts and rows without an id have none; an empty table
    gives an empty result. Values are counted before they are joined back, and frequent ones spread.
    """
    model = sources[0][1].sparkSession.sparkContext.broadcast(decoder)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts, srcs = b.column(2).to_pylist(), b.column(0).to_pylist()
                values = [pieces(t) for t in texts]
                if model.value is not None:
                    asked = [i for i, v in enumerate(values) if v and srcs[i] in DECODED]
                    for i, (_, damaged, _) in zip(asked, model.value.repair([texts[i] for i in asked])):
                        if damaged:
                            values[i] = []
                some = pa.array([i for i, v in enumerate(values) if v], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array([v for v in values if v], pa.list_(pa.string()))], ["src", "rec_id", "pieces"])

    some = spread(_texts(sources)).mapInArrow(cut_up, "src string, rec_id bigint, pieces array<string>")
    each = cut(some).select("src", "rec_id", F.explode("pieces").alias("value")).distinct()
    odd = classes(each.groupBy("value").agg(F.count("*").alias("n")))
    return join_counted(each, odd, ["value"], "n", ["src", "rec_id"]).select("src", "rec_id", "value", "canonical")


def sources_of(scans: DataFrame, flags: DataFrame) -> list[tuple[str, DataFrame, str, str]]:
    return [("visible_text", scans, "scan_id", "visible_text"), ("hidden_text", scans, "scan_id", "hidden_text"), ("evidence", flags, "flag_id", "evidence")]


def found(scans: DataFrame, flags: DataFrame, decoder: Repairer | None = None) -> DataFrame:
    """(src, rec_id) of every text that isn't in the one form, but for those damaged by a wrong decoding, under the model
    that p1 has of all texts of these tables where none is given."""
    model = decoder or repairer_for((scans, "scan_id", "visible_text"), (flags, "flag_id", "evidence"))
    return variants(sources_of(scans, flags), model).select("src", "rec_id").distinct()


def unified(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(src, rec_id, text): the texts that aren't in the one form, brought to it; equal looks are then equal texts.

    Damaged texts too are brought to it, as they are. Texts without any character that could stand in for another are
    left out before anything is shuffled.
    """
    pairs = variants(sources).groupBy("src", "rec_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "canonical"))).alias("canon"))
    texts = _texts(sources).where(F.col("text").rlike(any_pattern())).dropDuplicates(["src", "rec_id"]).join(pairs, ["src", "rec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = re.compile(r"([ \t\r\n]+)")
        for b in batches:
            out = []
            for t, canon in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                to = dict(canon)
                out.append("".join([to.get(p, p) for p in cuts.split(t)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["src", "rec_id", "text"])

    return texts.select("src", "rec_id", "text", "canon").mapInArrow(run, "src string, rec_id bigint, text string")
