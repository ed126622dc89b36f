"""Raw text and character maps of PDF files, with the standard library only.

Literal strings of the content streams are enough to search for instructions and for fonts that show one character and
mean another; layout needs a full reader, which may be plugged in as another source of spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_BEGIN = re.compile(rb"(?<!end)stream\r?\n")
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_HEX = re.compile(rb"<([0-9A-Fa-f\s]+)>")
_OBJECT = re.compile(rb"(?:^|\s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
#: Escapes in literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
RANGE_MOST = 65_536
STREAM_BYTES = 64 << 20
#: Bytes that are unfolded at once; small, since the piece in which a stream breaks is lost.
_PIECE = 64


def unescape(raw: bytes) -> str:
    """A literal string's text: escapes and octal codes resolved, UTF-16 with a mark, else Latin-1."""
    out = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return out[2:].decode("utf-16-be", "replace") if out[:2] == b"\xfe\xff" else out.decode("latin-1")


class TooLarge(ValueError):
    """A stream beyond the limit."""


def inflate(data: bytes) -> bytes:
    """A deflated stream, of a broken one what comes before the break. Raises ``TooLarge`` beyond ``STREAM_BYTES``."""
    d, out, size, piece = zlib.decompressobj(), [], 0, b""
    try:
        for at in range(0, len(data), _PIECE):
            piece = data[at : at + _PIECE]
            while piece and not d.eof:
                out.append(d.decompress(piece, STREAM_BYTES + 1 - size))
                size += len(out[-1])
                if size > STREAM_BYTES:
                    raise TooLarge(f"a stream unfolds to more than {STREAM_BYTES} bytes")
                piece = d.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def _pieces(content: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """(what stands before a stream, its raw bytes) in order, and what follows the last with None.

    A keyword begins a stream only after a dictionary; a stream that isn't closed ends with the file. Every byte is
    looked at a bounded number of times, whatever is nested.
    """
    at = 0
    for m in _BEGIN.finditer(content):
        if m.start() < at or not content[max(at, m.start() - 16) : m.start()].rstrip().endswith(b">>"):
            continue
        end = content.find(b"endstream", m.end())
        end = len(content) if end < 0 else end
        yield content[at : m.start()], re.sub(rb"\r?\n$", b"", content[m.end() : end])
        at = end
    yield content[at:], None


def streams(content: bytes) -> Iterator[bytes]:
    """The streams in order, unfolded where their dictionary says that they are deflated."""
    for head, data in _pieces(content):
        if data is not None:
            yield inflate(data) if b"FlateDecode" in head[head.rfind(b"obj") + 1 :] else data


def raw_text(content: bytes | None) -> str:
    """The literal strings of all streams, a line per stream, and of the file's own bytes outside them, a line."""
    if not content:
        return ""
    outside = b" ".join([head for head, _ in _pieces(content)])
    lines = [" ".join([unescape(x) for x in _LITERAL.findall(s)]) for s in (*streams(content), outside)]
    return "\n".join([x for x in lines if x.strip()])


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Code -> text of a character map: single characters and ranges (of at most ``RANGE_MOST`` codes)."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        codes = _HEX.findall(block)
        out.update((int(a, 16), text(b)) for a, b in zip(codes[::2], codes[1::2]))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[([^\]]*)\])", block):
            first, last = int(m[1], 16), int(m[2], 16)
            if last < first or last - first >= RANGE_MOST:
                continue
            if m[3]:
                start = text(m[3])
                out.update((first + k, start[:-1] + chr((ord(start[-1]) + k) & 0xFFFF)) for k in range(last - first + 1) if start)
            else:
                out.update((first + k, text(h)) for k, h in enumerate(_HEX.findall(m[4])) if first + k <= last)
    return out


def objects(content: bytes) -> dict[int, bytes]:
    """Object number -> its bytes; of several with one number the last."""
    return {int(m[1]): m[2] for m in _OBJECT.finditer(content)}


def fonts(content: bytes) -> list[dict]:
    """Fonts that have a character map: number, whether embedded, map."""
    found, all_ = [], objects(content)
    for n, body in all_.items():
        if b"/Font" in body and (m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)):
            stream = next(streams(all_.get(int(m[1]), b"")), b"")
            descriptor = re.search(rb"/FontDescriptor\s+(\d+)\s+\d+\s+R", body)
            embedded = bool(descriptor and re.search(rb"/FontFile[23]?\b", all_.get(int(descriptor[1]), b""))) or b"/Type0" in body
            found.append({"font": n, "embedded": embedded, "cmap": to_unicode(stream)})
    return found


_XFA = re.compile(rb"/XFA\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")


def xfa(content: bytes) -> str:
    """The text of the form's streams, tags removed, be it one or a list of parts; empty where there is no form."""
    all_, out = None, []
    for m in _XFA.finditer(content):
        all_ = objects(content) if all_ is None else all_
        for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]):
            for s in streams(all_.get(int(n), b"")):
                out.append(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", s.decode("utf-8", "replace"))).strip())
    return "\n".join([x for x in out if x])


def read(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(doc, text, form, has_form, ok, error) of the PDF files in a ``binaryFile`` table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, c in zip(b[name], b[content]):
                try:
                    if not c or not c.lstrip()[:5] == b"%PDF-":
                        raise ValueError("not a PDF file")
                    rows.append((n, raw_text(c), xfa(c), b"/XFA" in c, True, None))
                except Exception as e:  # one bad file must not fail the batch
                    rows.append((n, None, None, None, False, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["doc", "text", "form", "has_form", "ok", "error"])

    return files.select(name, content).mapInPandas(run, "doc string, text string, form string, has_form boolean, ok boolean, error string")


def read_fonts(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(doc, font, embedded, cmap) of every font with a character map; of a file with a map beyond the limit one row
    without a font."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, c in zip(b[name], b[content]):
                try:
                    rows += [(n, f["font"], f["embedded"], list(f["cmap"].items())) for f in fonts(c or b"")]
                except TooLarge:
                    rows.append((n, None, None, []))
            yield pd.DataFrame(rows, columns=["doc", "font", "embedded", "pairs"])

    pairs = files.select(name, content).mapInPandas(run, "doc string, font int, embedded boolean, pairs array<struct<k:int,v:string>>")
    return pairs.selectExpr("doc", "font", "embedded", "map_from_entries(pairs) AS cmap")
