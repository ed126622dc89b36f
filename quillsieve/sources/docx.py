"""Word processing documents as rows of text runs.

The parser is the only Python step: it reads the package within limits and emits runs and parts; all classification is
done on the rows by ``operators.visibility``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Limits against packages that unfold to far more than they weigh.
PART_BYTES, PACKAGE_BYTES, RATIO = 32 << 20, 128 << 20, 200
#: Rows from which a frame is handed on.
FRAME_ROWS = 20_000
#: Names of the WordprocessingML, drawing and core property schemas.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TEXT_PARTS = re.compile(r"word/(document|header\d*|footer\d*|comments|footnotes|endnotes)\.xml$")
_META_PARTS = re.compile(r"docProps/(core|app|custom)\.xml$")
RUNS = (
    "doc string, part string, para int, run int, text string, vanish string, has_vanish boolean, color string, highlight string, run_shd string, para_shd string, doc_bg string, "
    "size_half_pt double, kind string, ok boolean, error string"
)
_COLUMNS = [c.split()[0] for c in RUNS.split(", ")]


class TooLarge(ValueError):
    """A package beyond the limits."""


def parts(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the XML parts in order of name; a running total guards the whole package."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if not info.filename.endswith(".xml"):
                continue
            total += info.file_size
            if info.file_size > PART_BYTES or total > PACKAGE_BYTES or info.file_size > RATIO * max(1, info.compress_size):
                raise TooLarge(f"{info.filename} unfolds to {info.file_size} bytes")
            with z.open(info) as f:
                data = f.read(PART_BYTES + 1)
            if len(data) > PART_BYTES:
                raise TooLarge(info.filename)
            yield info.filename, data


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:4096]:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else e.get(W + name)


def _run_text(r: ElementTree.Element) -> str:
    out = []
    for e in r.iter():
        if e.tag in (W + "t", W + "delText", W + "instrText"):
            out.append(e.text or "")
        elif e.tag in (W + "tab", W + "br", W + "cr"):
            out.append(" ")
    return "".join(out)


def runs(name: str, content: bytes | None) -> list[dict]:
    """The runs of one document; alternative texts and metadata come as runs of their own kind. A document that can't be
    read gives one row with ok false and the reason."""
    base = dict.fromkeys(_COLUMNS) | {"doc": name, "ok": True}
    out: list[dict] = []
    try:
        if not content:
            raise ValueError("no content")
        for part, data in parts(content):
            if _META_PARTS.search(part):
                for k, e in enumerate(_tree(data).iter()):
                    if (e.text or "").strip():
                        out.append(base | {"part": part, "para": 0, "run": k, "text": e.text.strip(), "kind": "metadata", "has_vanish": False})
            elif m := _TEXT_PARTS.search(part):
                root = _tree(data)
                page = _attr(root.find(f"{W}background"), "color")
                kind = "annotation" if m.group(1) in ("comments", "footnotes", "endnotes") else "text"
                for p, para in enumerate(root.iter(W + "p")):
                    para_shd = _attr(para.find(f"{W}pPr/{W}shd"), "fill")
                    for k, r in enumerate(para.iter(W + "r")):
                        pr = r.find(W + "rPr")
                        get = lambda tag, a="val", pr=pr: None if pr is None else _attr(pr.find(W + tag), a)
                        size = get("sz")
                        out.append(
                            base | {"part": part, "para": p, "run": k, "text": _run_text(r), "vanish": get("vanish"), "has_vanish": pr is not None and pr.find(W + "vanish") is not None, "color": get("color"),
                                    "highlight": get("highlight"), "run_shd": get("shd", "fill"), "para_shd": para_shd, "doc_bg": page, "size_half_pt": float(size) if size and size.isdigit() else None, "kind": kind}
                        )
                for k, e in enumerate(root.iter()):
                    if e.tag.endswith("}docPr") and (alt := e.get("descr") or e.get("title")):
                        out.append(base | {"part": part, "para": -1, "run": k, "text": alt, "kind": "alt_text", "has_vanish": False})
        return out
    except Exception as e:  # one bad file must not fail the batch
        return [base | {"ok": False, "error": f"{type(e).__name__}: {e}"[:300]}]


def read(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Runs of the documents in a ``binaryFile`` table (or any with a name and bytes)."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"para": "Int32", "run": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for n, c in zip(b[name], b[content]):
                rows += runs(n, c)
                if len(rows) > FRAME_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return files.select(name, content).mapInPandas(run, RUNS)
