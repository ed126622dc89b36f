"""Freely typed values mapped to the entries of a reference list.

The forms of all entries (labels, aliases, regular derivations) are indexed by symmetric deletion: every form under each
string that deleting up to two of its first letters gives, so a typed value meets its candidates by a few dictionary
look-ups. Candidates are ranked by weighted Damerau-Levenshtein distance and then by how often their entry is typed
correctly. A value that meets none is aligned word by word, by the same distance; one that still meets none is reported
as a miss. Each distinct value is matched once and joined back to its rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, slots
from .lookalike import alike

#: First letters of a form whose deletions are indexed.
PREFIX = 8
#: The reference list is a parameter table; a larger one must be split by kind first.
MOST_ENTRIES = 20_000
#: Bounds of the map of distinct values that is broadcast, and rows of one value that one task may get in the other join.
BROADCAST_VALUES, BROADCAST_CHARS, HOT_ROWS = 400_000, 8_000_000, 1_000_000
NONE = "none"

# Public names that no rule below gives, by kind and label. Languages: other names in use beside CLDR's.
# Levels: the descriptors of the CEFR global scale, of the ILR scale and of the scales usual in German and Czech CVs.
# Education: degrees and school-leaving exams of the European countries. Skills: other names of the products and trades.
SYNONYMS = {
    "lang": {"Slovenian": "Slovene", "Spanish": "castellano|Castilian", "Dutch": "Flemish|holandština|Hollandisch", "Greek": "novořečtina"},
    "level": {
        "A1": "starter|novice",
        "B1": "threshold|limited working proficiency|konversationssicher|komunikativně",
        "B2": "professional working proficiency|fortgeschritten",
        "C1": "advanced|effective operational proficiency|full professional proficiency|verhandlungssicher|plynule",
        "C2": "proficient|bilingual proficiency",
        "native": "mateřský jazyk|first language|Muttersprachler",
    },
    "edu": {
        "secondary": "gymnázium|Gymnasium|liceum|baccalauréat|bachillerato|A-levels|secondary school",
        "bachelor": "BA|licence|licencjat|bakalár|undergraduate",
        "master": "MA|magister|inženýr|inžinier|Diplom|Diplom-Ingenieur|máster|maîtrise",
        "phd": "doctor|doktor|Dr.|CSc.|doctorat|doctorado",
        "course": "školení|Schulung|Weiterbildung|cours|curso|kurs|szkolenie|workshop",
    },
    "skill": {
        "Python": "Py",
        "JavaScript": "ECMAScript",
        "PostgreSQL": "PgSQL",
        "Apache Spark": "PySpark",
        "Ruby on Rails": "Rails",
        "Recruitment": "recruiting",
        "Accounting": "bookkeeping",
        "Customer service": "customer care|customer support|Kundendienst",
        "Forklift operation": "VZV|Gabelstapler",
    },
}
#: Makers whose name may stand before a product's or be left out.
MAKERS = {"microsoft": "ms", "apache": "", "adobe": "", "amazon": "", "google": "", "oracle": "", "atlassian": "", "hashicorp": "", "gnu": ""}
#: Last words of an entry's name that may be left out.
TAILS = ("database", "db", "operation", "machining")
#: The languages whose CLDR names of languages are forms.
NAMED_IN = ("en", "cs", "de", "fr", "es", "pl", "sk", "uk")
# Words that stand beside a value without changing what it means, folded.
BESIDE = {
    "lang": "language jazyk sprache jezyk active passive spoken written daily use business basic fluent british american",
    "level": "level uroven niveau cca self assessed circa about approx stupen",
    "edu": "degree stupen title titul dokonceno completed studies vzdelani education level diploma",
    "skill": "language lang developer development programming skills skill admin administration cluster queries dotazy cache streams containers playbooks design framework software scripting desktop platform apps app models database databases db methodology basics advanced years year roky roku let daily use certified expert user library tools scripts pipelines dashboards cloud ansi jazyk microsoft ms adobe apache atlassian hashicorp gnu",
}
_AROUND = [
    re.compile(p)
    for p in (
        r"^(?:basics? of|language|level|uroven|niveau|cca|ca\.?|title|titul|approx\.?|circa)\s*:?\s+(?=\S)",
        r"^[*•\-–>#]+\s+",
        r"\s*[,\-–]\s*(?:daily use|\d+\+?\s*(?:years?|roky|roku|rokov|let|jahre?|ans|anos|lat[a]?)|dokonceno|completed)$",
        r"\s*\((?:[^()]*)\)?$",
        r"\s+(?:jazyk/language|degree/stupen)$",
    )
]
_VERSION = re.compile(r"\s*\bv?\d+(?:\.\d+)*[a-z]?$")
_NEAR_KEYS = {frozenset(p) for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm") for p in zip(row, row[1:])}


def fold(text: str) -> str:
    """Small letters without accents, stand-ins put right, runs of white space and underscores one space."""
    t = alike(text.replace("_", " ")).casefold()
    if not t.isascii():
        t = "".join([c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)]).replace("ł", "l").replace("ß", "s")
    return re.sub(r"\s+", " ", t).strip()


def squeeze(folded: str) -> str:
    """Without spaces, hyphens and dots, so spellings that differ by these fall together."""
    return re.sub(r"[\s.\-/'’]+", "", folded)


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein (restricted): a swap of neighbours 0.8, a letter doubled or lost from a pair 0.7,
    a substitution of neighbouring keys 0.8, any other edit 1; a changed first letter 0.3 more. Beyond ``most``: infinity."""
    if abs(len(a) - len(b)) > most + 1:
        return float("inf")
    band, n, far = int(most / 0.7) + 1, len(b), float("inf")  # further from the diagonal no path is within the bound
    before: list[float] = []
    last = [float(j) if j <= band else far for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (n + 1)
        low = far
        if i <= band:
            row[0] = low = float(i)
        twin, prev = a[i - 2] == x if i > 1 else False, a[i - 2] if i > 1 else ""
        for j in range(max(1, i - band), min(n, i + band) + 1):
            y = b[j - 1]
            best = last[j - 1] + (0.0 if x == y else 0.8 if frozenset((x, y)) in _NEAR_KEYS else 1.0)
            d = last[j] + (0.7 if twin else 1.0)
            if d < best:
                best = d
            d = row[j - 1] + (0.7 if j > 1 and b[j - 2] == y else 1.0)
            if d < best:
                best = d
            if prev and j > 1 and x == b[j - 2] and y == prev:
                d = before[j - 2] + 0.8
                if d < best:
                    best = d
            row[j] = best
            if best < low:
                low = best
        if low > most:
            return far
        before, last = last, row
    d = last[-1] + (0.3 if a[:1] != b[:1] and last[-1] else 0)
    return d if d <= most else float("inf")


def bound(length: int) -> float:
    """The largest distance that a value of this length may have from a form."""
    return 0.0 if length <= 3 else 0.85 if length == 4 else 1.3 if length <= 7 else 2.0


def deletions(word: str, most: int) -> set[str]:
    """The word's prefix and all that deleting up to ``most`` of its letters gives."""
    out = level = {word[:PREFIX]}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def derived(kind: str, label: str | None, label_cs: str | None, label_de: str | None, aliases: list[str] | None = None, cldr: list[str] | None = None) -> list[str]:
    """Regular derivations of an entry's names.

    Languages: CLDR's names, Czech adverbs and adjectives, 'language' beside the name, the school's initial and J (jazyk).
    All: initials of names of several words, of words with inner capitals, makers left out or shortened, signs spelled
    out, last words that may be left out.
    """
    out = []
    names = [n for n in (label, label_cs, label_de, *(aliases or ())) if n]
    if kind == "lang":
        if label_cs:
            out.append(label_cs[0].upper() + "J")
            for end, to in (("němčina", "německ"), ("čeština", "česk"), ("čtina", "ck"), ("ština", "sk"), ("čina", "ck")):
                if label_cs.endswith(end):
                    stem = label_cs[: -len(end)] + to
                    out += [stem + "y", stem + "ý", stem + "ý jazyk"]
                    break
        if label:
            out += [f"{label} language", f"language {label}"]
        if label_de:
            out += [f"{label_de}e Sprache"]
        for n in cldr or ():
            out += [n, f"język {n}", f"{n} language"]
        return out
    for n in names:
        words = n.split()
        if len(words) > 1:
            initials = "".join([w[0] for w in words if w[0].isalpha() and w.lower() not in ("of", "on", "in", "and")])
            if len(initials) >= (2 if kind == "edu" else 3):
                out.append(initials)
            if kind == "skill" and words[0].lower() in MAKERS:
                rest = " ".join(words[1:])
                out += [rest] * (rest.lower() not in BESIDE["skill"].split()) + [f"{MAKERS[words[0].lower()]} {rest}"] * bool(MAKERS[words[0].lower()])
            if kind == "skill" and words[-1].lower() in TAILS:
                out.append(" ".join(words[:-1]))
        if kind == "skill":
            short = [w if len(re.findall("[A-Z]", w)) < 2 or w.isupper() else "".join(re.findall("[A-Z]", w)) for w in words]
            if short != words and len("".join(short)) > 3:
                out.append(" ".join(short))
            if n[-1:] in "+#":
                out.append(n.replace("+", " plus").replace("#", " sharp"))
            if len(n) <= 5:  # too short for edits in it, so it is met with a word beside it
                out += [f"language {n}", f"jazyk {n}", f"ANSI {n}", *[f"{n} {w}" for w in ("language", "lang", "programming", "developer", "queries", "dotazy", "cache")]]
    return out


class Matcher:
    """The symmetric-delete dictionaries of every kind of entry: of whole forms, and of the words of forms."""

    def __init__(self, entries: list[tuple[str, str, str | None, str | None, str | None, list[str] | None]], cldr: dict[str, list[str]] | None = None, synonyms: dict[str, dict[str, str]] | None = None):
        """entries: (ref_id, ref_kind, label, label_cs, label_de, aliases); cldr: for a label its further names."""
        self.exact: dict[tuple[str, str], str] = {}
        self.index: dict[tuple[str, str], set[tuple[str, str]]] = {}
        self.words: dict[tuple[str, str], set[str]] = {}  # deletion -> words of forms
        self.stems: dict[tuple[str, str], set[str]] = {}  # first three letters -> words of forms
        self.forms: dict[tuple[str, str], set[tuple[tuple[str, ...], str]]] = {}  # word -> forms as words
        self.frequency: dict[str, int] = {}
        self.beside = {k: set(v.split()) for k, v in BESIDE.items()}
        ranked: list[tuple[int, str, str, str]] = []
        for ref_id, kind, label, cs, de, aliases in entries:
            if not ref_id or not kind:
                continue
            names = [(0, n) for n in (label, cs, de, *(aliases or ())) if n]
            names += [(1, n) for n in (SYNONYMS if synonyms is None else synonyms).get(kind, {}).get(label or "", "").split("|") if n]
            names += [(2, n) for n in derived(kind, label, cs, de, aliases, (cldr or {}).get(label or ""))]
            ranked += [(rank, kind, n, ref_id) for rank, n in names]
        for _, kind, name, ref_id in sorted(ranked, key=lambda r: r[0]):
            f = fold(name).strip(" .,;:")
            for form in dict.fromkeys((f, squeeze(f))):
                if not form:
                    continue
                if self.exact.setdefault((kind, form), ref_id) == ref_id and len(form) >= 4:
                    for d in deletions(form, 2 if len(form) >= 7 else 1):
                        self.index.setdefault((kind, d), set()).add((form, ref_id))
            if kind == "lang" or self.exact.get((kind, f)) != ref_id:
                continue
            tokens = tuple(w for w in re.split(r"[\s\-/]+", f) if len(w) > 1 and w not in self.beside[kind]) if kind in self.beside else ()
            for w in tokens if any(len(t) >= 3 for t in tokens) else ():
                self.forms.setdefault((kind, w), set()).add((tokens, ref_id))
                self.stems.setdefault((kind, w[:3]), set()).add(w)
                if len(w) >= 4:
                    for d in deletions(w, 1):
                        self.words.setdefault((kind, d), set()).add(w)

    def near(self, kind: str, form: str) -> tuple[float, str] | None:
        """(distance, ref_id) of the best form within the bound."""
        if (got := self.exact.get((kind, form))) is not None:
            return 0.0, got
        most = bound(len(form) + (len(form) == 4))
        if not most:
            return None
        found: set[tuple[str, str]] = set()
        for d in deletions(form, 2 if len(form) >= 7 else 1):
            found |= self.index.get((kind, d), set())
        best: dict[str, float] = {}
        for other, ref_id in found:
            d = distance(form, other, min(most, bound(max(len(form), len(other)) if len(other) == 5 else len(other)), 1.0 if len(form) == 4 else 9))
            if d < best.get(ref_id, float("inf")):
                best[ref_id] = d
        if not best:
            return None
        ref_id = min(best, key=lambda r: (round(best[r], 3), -self.frequency.get(r, 0), r))
        return best[ref_id], ref_id

    def match(self, kind: str, value: str) -> str | None:
        """The ref_id that a value means, NONE if it means none of the entries, None for a blank one."""
        folded = fold(value)
        if not folded:
            return None
        return self._match(kind, folded) or NONE

    def exactly(self, kind: str, value: str) -> str | None:
        """The ref_id of which the folded value is a form, None for any other."""
        f = fold(value).strip(" .,;:")
        return self.exact.get((kind, f)) or self.exact.get((kind, squeeze(f)))

    def _match(self, kind: str, folded: str) -> str | None:
        tries = [folded.strip(" .,;:")] if folded.strip(" .,;:") else []
        t = folded.strip(" ,;\t")
        for _ in range(3):
            for rx in _AROUND:
                t = rx.sub("", t).strip(" .,;:") or t
        tries.append(t)
        bare = _VERSION.sub("", t).strip(" .,;:")
        if bare and bare != t:
            tries.append(bare)
        if kind == "skill":
            tries += [x[:-2].rstrip(" .") for x in tries if x.endswith("js") and len(x) > 5]
        tries = list(dict.fromkeys(x for x in tries if x))
        for x in tries:  # exact before near
            for form in (x, squeeze(x)):
                if (got := self.exact.get((kind, form))) is not None:
                    return got
        if kind == "level" and (m := re.search(r"(?<![a-z0-9])([abc][12])(?![a-z0-9])", folded)) and (got := self.exact.get((kind, m.group(1)))):
            return got
        for x in tries:
            if len(x) >= 4 and f"{x}." in folded and (got := self._abbreviated(kind, x)):
                return got
        best: tuple[float, str] | None = None
        for x in tries:
            for form in dict.fromkeys((x, squeeze(x))):
                if (n := self.near(kind, form)) and (best is None or n[0] < best[0]):
                    best = n
        if best:
            return best[1]
        return (self._inside(kind, tries[-1]) or self._aligned(kind, tries[-1]) or self._joined(kind, squeeze(tries[-1]))) if tries else None

    def _abbreviated(self, kind: str, text: str) -> str | None:
        """The one entry of which a form begins with the text."""
        found = {ref for (k, form), ref in self.exact.items() if k == kind and form.startswith(text)}
        return found.pop() if len(found) == 1 else None

    def _inside(self, kind: str, text: str) -> str | None:
        """An entry's form among the words of a longer value, the rest being words that may stand beside it."""
        words = [w.strip(",;:()") for w in re.split(r"[\s/]+", text)]
        words = [w for w in words if w]
        best: tuple[float, str] | None = None
        for i in range(len(words)):
            for j in range(len(words), i, -1):
                if j - i == len(words):
                    continue
                part, rest = " ".join(words[i:j]), words[:i] + words[j:]
                plain = all(w in self.beside[kind] or re.fullmatch(r"v?\d+(?:\.\d+)*", w) or self._beside_near(kind, w) for w in rest)
                if plain:
                    hit = self.near(kind, part) or self.near(kind, squeeze(part))
                else:
                    ref = self.exact.get((kind, part)) if kind == "skill" and len(part) >= 3 else None
                    hit = (0.0, ref) if ref else None
                if hit:
                    score = len(part) - 2 * hit[0]
                    if best is None or score > best[0]:
                        best = (score, hit[1])
        return best[1] if best else None

    def _beside_near(self, kind: str, word: str) -> bool:
        return len(word) >= 5 and any(abs(len(b) - len(word)) <= 1 and distance(word, b, 1.3) <= 1.3 for b in self.beside[kind] if len(b) >= 5)

    def stems_of(self, kind: str) -> list[str]:
        return [w for (k, w) in self.forms if k == kind]

    def _tokens(self, kind: str, word: str) -> dict[str, float]:
        """Words of forms that a word stands for, with the letters they share: itself, of the same stem, an abbreviation that
        begins or skeletonises it, or one within the bound."""
        out: dict[str, float] = {}
        if (kind, word) in self.forms:
            out[word] = len(word)
            return out
        for w in self.stems.get((kind, word[:3]), ()):
            common = next((i for i, (x, y) in enumerate(zip(word, w)) if x != y), min(len(word), len(w)))
            if common >= 4 and common >= 0.6 * max(len(word), len(w)):
                out[w] = common
            elif 3 <= common == len(word) < len(w):
                out[w] = -common  # an abbreviation, which needs another word of the form beside it
        if len(word) >= 4 and not set(word) & set("aeiouy"):
            for w in self.stems_of(kind):
                if w[0] == word[0] and w[-1] == word[-1] and len(w) > len(word) and all(c in it for it in [iter(w)] for c in word):
                    out[w] = -len(word)
        if len(word) >= 5:
            for d in deletions(word, 1):
                for w in self.words.get((kind, d), ()):
                    far = distance(word, w, bound(min(len(word), len(w))))
                    if 7 <= len(w) < len(word) <= len(w) + 3:  # an edit before an inflected ending
                        far = min(far, distance(word[: len(w)], w, bound(len(w))))
                    if w not in out and far < 9:
                        out[w] = len(w) - 2 * far
        return out

    def _aligned(self, kind: str, text: str) -> str | None:
        """The entry of which a form has all its words among the value's, in whatever order and inflection; of several
        entries that with the most letters, none where two have as many."""
        if kind not in self.beside or kind == "lang":
            return None
        met: dict[str, float] = {}
        for word in re.split(r"[\s/\-,;:()]+", text):
            if len(word) >= 2:
                for w, letters in self._tokens(kind, word).items():
                    met[w] = max(met.get(w, 0), letters, key=abs)
        best: dict[str, float] = {}
        for w in met:
            for tokens, ref in self.forms.get((kind, w), ()):
                if all(t in met for t in tokens) and any(met[t] > 0 for t in tokens) and (score := sum(abs(met[t]) for t in tokens)) >= 3:
                    best[ref] = max(best.get(ref, 0), score)
        top = max(best.values(), default=0)
        found = [r for r, v in best.items() if v == top]
        return found[0] if len(found) == 1 else None

    def _joined(self, kind: str, squeezed: str) -> str | None:
        """An entry's form of six letters or more at the beginning or the end of a value written without spaces."""
        for size in range(len(squeezed) - 1, 5, -1) if kind != "lang" else ():
            for part in (squeezed[:size], squeezed[-size:]):
                if (got := self.exact.get((kind, part))) is not None:
                    return got
        return None


def cldr_names(spark: SparkSession, labels: list[str]) -> dict[str, list[str]]:
    """For each English name of a language its names in ``NAMED_IN`` and in itself, by the Java runtime's CLDR data."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale("en")
    codes: dict[str, list[str]] = {}
    for code in locale.getISOLanguages():
        name = locale(code).getDisplayLanguage(english)
        for label in labels:
            if name == label or name.startswith(f"{label} "):
                codes.setdefault(label, []).append(code)
    return {label: sorted({locale(c).getDisplayLanguage(locale(n)) for c in found for n in (*NAMED_IN, c)}) for label, found in codes.items()}


def matcher(reference: DataFrame) -> Matcher:
    """The dictionaries of a reference list, whose size is checked before it is collected and broadcast."""
    rows = reference.select("ref_id", "ref_kind", "label", "label_cs", "label_de", "aliases").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return Matcher([tuple(r) for r in rows], cldr_names(reference.sparkSession, [r.label for r in rows if r.ref_kind == "lang" and r.label]))


#: (src, table, value column, kind of entry)
SOURCES = (("skill_name", "q_skills", "name", "skill"), ("language", "q_languages", "language", "lang"), ("level_raw", "q_languages", "level_raw", "level"), ("edu_level", "q_education", "level", "edu"))


def _values(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [tables[t].where(F.col("row_id").isNotNull() & F.col(c).isNotNull()).select(F.lit(src).alias("src"), F.col("row_id").cast("long").alias("row_id"), F.lit(kind).alias("kind"), F.col(c).alias("value")) for src, t, c, kind in SOURCES if t in tables]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _python(values: DataFrame, of, out: str) -> DataFrame:
    """(kind, value, ``out``) of the distinct values by a function of (kind, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [of(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.string())], ["kind", "value", "n", out])

    return values.select("kind", "value", "n").mapInArrow(run, f"kind string, value string, n bigint, {out} string")


def distinct_values(values: DataFrame) -> DataFrame:
    """(kind, value, n): each value typed once, with how many rows have it; counted before the shuffle, cut, then read twice."""
    counted = values.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return cut(counted.repartition(slots(values.sparkSession) * 2, "kind", "value"))


def with_frequency(m: Matcher, exact: DataFrame) -> Matcher:
    """Count for each entry how many rows (n) are typed exactly as one of its forms, folded as in matching."""
    counted = exact.where("ref_id IS NOT NULL").groupBy("ref_id").agg(F.sum("n").alias("n"))
    m.frequency = {r.ref_id: int(r.n) for r in counted.collect()}
    return m


def mapped(tables: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """(src, row_id, value, ref_id) of every non-blank value; ref_id is 'none' where it means none of the entries.

    Null and blank values and rows without an id have no row; repeated rows come once; an empty reference list maps all
    to 'none'; empty tables give an empty result. Only distinct values are matched. The map is joined back by broadcast
    if it has at most ``BROADCAST_VALUES`` values of at most ``BROADCAST_CHARS`` characters together; a larger one by a
    shuffle in which values of more than ``HOT_ROWS`` rows are spread over as many salts as they need.
    """
    values = _values(tables)
    distinct = distinct_values(values)
    sc = values.sparkSession.sparkContext
    plain = sc.broadcast(m := matcher(reference))
    shared = sc.broadcast(with_frequency(m, _python(distinct, lambda k, v: plain.value.exactly(k, v), "ref_id")))
    found = cut(_python(distinct, lambda k, v: shared.value.match(k, v), "ref_id").where("ref_id IS NOT NULL"))
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    return joined_back(values, found, size.n <= BROADCAST_VALUES and size.chars <= BROADCAST_CHARS)


def joined_back(values: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """The rows of ``values`` with what ``found`` (kind, value, n, ref_id) has for their value."""
    if small:
        rows = values.join(F.broadcast(found.drop("n")), ["kind", "value"])
    else:
        salts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
        hot = found.where(F.col("n") > HOT_ROWS).select("kind", "value", salts.alias("salts"))
        each = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
        # Fewer than rows / HOT_ROWS values are hot, but that bound grows with the data, so the planner decides how to join.
        salted = values.join(hot, ["kind", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("src", "row_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        rows = salted.join(each, ["kind", "value", "salt"])
    return rows.select("src", "row_id", "value", "ref_id").dropDuplicates(["src", "row_id"])


def misses(found: DataFrame) -> DataFrame:
    """(src, value, n_rows): the values that mean none of the entries, with how many rows have them."""
    return found.where(F.col("ref_id") == NONE).groupBy("src", "value").agg(F.count("*").alias("n_rows"))
