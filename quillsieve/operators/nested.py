"""Flat tables from deeply nested answers, by Merkle subtree identities.

Every object and list of an answer is canonicalised and hashed from the leaves up, so equal subtrees have equal
identities wherever they stand; a document is the root of its tree, with all its members. ``objects`` holds each distinct
subtree once, its nested subtrees replaced by their identities; ``bridge`` holds every occurrence: which node of which
document of which extraction is the ``ord``-th child under which field of which parent. The flat tables are the bridge's
entries joined with the objects.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import join_counted, spread

BLOCKS = ("experience", "skills", "education", "languages", "certifications")
#: The member that an object of the block must have to count; education objects always count.
NEEDED = {"experience": "title", "skills": "name", "languages": "language", "certifications": "name"}
#: The members that become columns of the flat tables.
COLUMNS = {
    "experience": ("title", "employer", "start", "end", "months", "seniority", "evidence"),
    "skills": ("name", "category", "level", "evidence"),
    "education": ("level", "field", "institution", "year"),
    "languages": ("language", "level", "level_raw"),
    "certifications": ("name", "year"),
}
#: Subtrees nested deeper than this stay whole, as one leaf {"$json": text}.
DEEPEST = 200
#: Hexadecimal digits of an identity, the beginning of a SHA-256.
DIGITS = 40

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_OPEN = re.compile(r"[{\[]")
_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_DECODER = json.JSONDecoder(strict=False)


def _closing(text: str, at: int) -> int:
    """Where the bracket at a place is closed, strings skipped; -1 if it isn't."""
    depth, quoted = 0, False
    for m in _TOKEN.finditer(text, at):
        c = m.group(0)
        if quoted or c == '"':
            quoted = c != '"' if quoted else True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return m.start()
    return -1


def salvage(raw: str | None) -> object:
    """The JSON value in a model's answer: as it is, out of a code fence, or among prose.

    Of the bracketed pieces of prose that are JSON the first with a qualification counts, else the first at all. None for
    null, blank and unreadable answers; a piece that isn't closed is a cut-off answer and ends the search.
    """
    if not raw or not raw.strip():
        return None
    text = m.group(1) if (m := _FENCE.match(raw)) else raw.strip()
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        pass
    first, at = None, 0
    while m := _OPEN.search(text, at):
        try:
            value, at = _DECODER.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            end = _closing(text, m.start())
            if end < 0:
                break
            at = end + 1
            continue
        if any(q is not None for q in qualifications(value)):
            return value
        first = value if first is None else first
    return first


def qualifications(value: object, depth: int = 0) -> list[object]:
    """The documents' qualifications in an answer, in order; a document without one is None and keeps its place.

    An object with one of the five blocks is a qualification. Otherwise a ``documents`` list, or a list at the top, has
    a document per element, and any other wrapping (also JSON inside a string) is opened until one is found.
    """
    if depth > 12:
        return []
    if isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", "`"):
            return []
        return qualifications(salvage(value), depth + 1)
    if isinstance(value, list):
        return [next((q for q in qualifications(x, depth + 1) if q is not None), None) for x in value]
    if not isinstance(value, dict):
        return []
    if any(b in value for b in BLOCKS):
        return [value]
    if isinstance(value.get("documents"), list):
        return qualifications(value["documents"], depth + 1)
    for inner in ("qualification", *value):
        if isinstance(value.get(inner), (dict, str, list)) and (found := qualifications(value[inner], depth + 1)) and any(q is not None for q in found):
            return found
    return []


def _leaf(v: object) -> str:
    if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v):
        v = int(v)
    return json.dumps(v, ensure_ascii=False)


def blank(v: object) -> bool:
    return v is None or isinstance(v, (dict, list)) or not str(v).strip()


def counts(block: str, v: object) -> bool:
    """Whether a member of a block is an entry: a non-blank string, or an object with the member that the block needs."""
    if isinstance(v, str):
        return bool(v.strip())
    return isinstance(v, dict) and (block not in NEEDED or not blank(v.get(NEEDED[block])))


def _identity(body: str) -> str:
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:DIGITS]


class Forest:
    """Collects the nodes of one document, bottom-up identities with them."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []  # node, parent node, field, ord, identity, body

    def add(self, value: object, parent: int, field: str, ord_: int, depth: int = 0) -> str:
        """Adds the subtree and gives its identity."""
        at = len(self.rows)
        self.rows.append(())
        if depth > DEEPEST and isinstance(value, (dict, list)):
            body = json.dumps({"$json": json.dumps(value, ensure_ascii=False, sort_keys=True)}, ensure_ascii=False)
        elif isinstance(value, dict):
            parts = [f"{json.dumps(k, ensure_ascii=False)}: {self.part(value[k], at, k, 0, depth)}" for k in sorted(value)]
            body = "{" + ", ".join(parts) + "}"
        elif isinstance(value, list):
            body = "[" + ", ".join([self.part(v, at, field, i, depth) for i, v in enumerate(value)]) + "]"
        else:
            body = _leaf(value)
        identity = _identity(body)
        self.rows[at] = (at, parent, field, ord_, identity, body)
        return identity

    def part(self, value: object, parent: int, field: str, ord_: int, depth: int) -> str:
        """A leaf as itself, an object or list by its identity."""
        if isinstance(value, (dict, list)):
            return '{"$ref": "' + self.add(value, parent, field, ord_, depth + 1) + '"}'
        return _leaf(value)


OCCURRENCES = "doc_ord bigint, node bigint, parent_node bigint, block string, field string, ord bigint, is_entry boolean, parent_id string, object_id string, body string"


def shred(raw: str | None) -> list[tuple]:
    """The occurrence rows of one answer, in the order of ``OCCURRENCES``; none for an unreadable one."""
    try:
        value = salvage(raw)
    except RecursionError:
        return []
    out: list[tuple] = []
    for doc_ord, q in enumerate(qualifications(value)):
        if not isinstance(q, dict):
            continue
        try:
            out.extend(_document(q, doc_ord))
        except RecursionError:
            continue
    return out


def _document(q: dict, doc_ord: int) -> list[tuple]:
    forest, out = Forest(), []
    members: dict[str, str] = {}
    for k in sorted(q):
        block, content = k if k in BLOCKS else None, q[k]
        if block is None:
            members[k] = json.dumps(content, ensure_ascii=False, sort_keys=True)
            continue
        kept = []
        for i, v in enumerate(content if isinstance(content, list) else [content]):
            if v is None:
                kept.append("null")
                continue
            first = len(forest.rows)
            kept.append(f'{{"$ref": "{forest.add(v, -1, block, i)}"}}')
            rows = forest.rows[first:]
            identity = {r[0]: r[4] for r in rows}
            out.extend((doc_ord, n, p, block, f, o, p == -1 and counts(block, v), identity.get(p), h, b) for n, p, f, o, h, b in rows)
        members[k] = "[" + ", ".join(kept) + "]" if isinstance(content, list) else kept[0]
    body = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in members.items()) + "}"
    root = _identity(body)
    return [(doc_ord, -1, None, None, None, doc_ord, False, None, root, body), *[(*r[:7], r[7] or root, *r[8:]) for r in out]]


def occurrences(extractions: DataFrame, key: str = "extraction_id", raw: str = "qualification_json", bodies: bool = True) -> DataFrame:
    """(key, ``OCCURRENCES``): every document of every answer and every node below its five blocks.

    Null, blank and unreadable answers have no rows. A document is node -1, without block, parent and field, its ord its
    place in the answer. A node directly in a block has parent_node -1, its ord is its place in the original list (0
    without a list), and parent_id is the identity of its document. Nulls in a list keep their place and have no row. Repeated rows give repeated rows; an empty table an empty one.
    """
    kind = extractions.schema[key].dataType.simpleString()
    names = ["doc_ord", "node", "parent_node", "block", "field", "ord", "is_entry", "parent_id", "object_id"] + ["body"] * bodies
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()] + [pa.string()] * (2 + bodies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows, of = [], []
                for i, r in enumerate(b.column(1).to_pylist()):
                    got = shred(r)
                    rows.extend(got)
                    of.extend([i] * len(got))
                columns = list(zip(*rows))[: len(names)] if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], [key, *names])

    schema = f"`{key}` {kind}, {OCCURRENCES if bodies else OCCURRENCES.removesuffix(', body string')}"
    return spread(extractions.select(key, raw)).mapInArrow(run, schema)


def objects(found: DataFrame) -> DataFrame:
    """(object_id, body, n_occurrences): each distinct subtree once; the count is of all its occurrences."""
    return found.groupBy("object_id").agg(F.min("body").alias("body"), F.count("*").alias("n_occurrences"))


def bridge(found: DataFrame) -> DataFrame:
    """Every occurrence, without the subtrees themselves."""
    return found.drop("body")


def entries(extractions: DataFrame) -> DataFrame:
    """(extraction_id, doc_ord, block, ord): the entries of the five blocks, each once however often its row came."""
    return occurrences(extractions, bodies=False).where("is_entry").select("extraction_id", "doc_ord", "block", "ord").distinct()


def flat(bridge: DataFrame, objects: DataFrame, block: str) -> DataFrame:
    """The flat table of one block: extraction_id, doc_ord, ord, parent_id (the document's identity), object_id and the
    block's members as strings; the bridge's entries, each with its object, which is parsed once however often it occurs.

    A string entry fills the member that names the entry (education: level); members of other types come as their JSON
    text, nested ones as a reference to their identity.
    """
    names = COLUMNS[block]
    is_text = F.col("body").startswith('"')
    plain = F.get_json_object(F.concat(F.lit('{"v": '), F.col("body"), F.lit("}")), "$.v")
    first = NEEDED.get(block, "level")
    parsed = F.from_json("body", ", ".join(f"`{n}` string" for n in names))
    members = objects.select("object_id", "n_occurrences", *[F.when(is_text, plain if n == first else None).otherwise(parsed[n]).alias(f"{block}_{n}") for n in names])
    rows = bridge.where((F.col("block") == block) & F.col("is_entry")).select("extraction_id", "doc_ord", "ord", "parent_id", "object_id")
    got = join_counted(rows, members, ["object_id"], "n_occurrences", ["extraction_id", "doc_ord", "ord"])
    return got.select("extraction_id", "doc_ord", "ord", "parent_id", "object_id", *[f"{block}_{n}" for n in names])
