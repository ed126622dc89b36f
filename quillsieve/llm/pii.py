"""Personal data in free text, found through its disguises and replaced by typed placeholders.

Transducers rewrite each text, keeping for every character of the result the place in the source that it came from:
look-alike characters become what they stand in for, unseen ones vanish, accents fall off, spelled-out digits become
digits, and the many ways to write the at sign and the dot become those signs. Identifiers are recognised in the
rewritten text and their spans are mapped back to the source. Names and street names are recognised by lexicons of all
parts of the known identities' names and of all streets of contact lines; a name that the lexicon can't give, and the
e-mail addresses and phone numbers of the scan's own identity are searched for besides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread
from .glyphs import FOREIGN, INVISIBLE, SIGNS, SPACES, compat

#: Documented bound of the distinct name parts and streets; beyond it ``fit`` fails instead of leaving any out.
LEXICON_MOST = 300_000
KINDS = ("name", "email", "phone", "id_number", "address")

# Ways to write the at sign and the dot, folded.
AT_WORDS = "at|zavinac|zavinac|arroba|arobase|arobas|malpa|klammeraffe|sobaka|собака|равлик|ет"
DOT_WORDS = "dot|tecka|bodka|punkt|punto|point|kropka|крапка|dotcom"
# Digits spelled out, by language.
SPELLED = {
    "zero one two three four five six seven eight nine": 0,
    "nula jedna dva tri ctyri pet sest sedm osm devet": 0,
    "null eins zwei drei vier funf sechs sieben acht neun": 0,
    "zero un deux trois quatre cinq six sept huit neuf": 0,
    "cero uno dos tres cuatro cinco seis siete ocho nueve": 0,
    "zero jeden dwa trzy cztery piec szesc siedem osiem dziewiec": 0,
    "nula jeden dva tri styri pat sest sedem osem devat": 0,
    "нуль один два три чотири п'ять шість сім вісім дев'ять": 0,
}
DIGITS = {w: str(i) for words in SPELLED for i, w in enumerate(words.split())} | {"oh": "0"}

_AT = rf"(?:\s?@\s?|\s?[(\[{{<]\s?(?i:{AT_WORDS})\s?[)\]}}>]\s?|\s(?:AT|ZAVINAC|ARROBA|AROBASE|MALPA|zavinac|arroba|arobase|malpa)\s)"
_DOT = rf"(?:\.|\s?[(\[{{<]\s?(?i:{DOT_WORDS})\s?[)\]}}>]\s?|\s(?:DOT|TECKA|BODKA|PUNKT|PUNTO|POINT|KROPKA|tecka|bodka|kropka)\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-/@])[\w+\-]+(?:{_DOT}[\w+\-]+)*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w\-])")
_AT_HINT = re.compile(rf"@|[(\[{{<]\s?(?i:{AT_WORDS})\s?[)\]}}>]|\s(?:AT|ZAVINAC|ARROBA|AROBASE|MALPA|zavinac|arroba|arobase|malpa)\s")
_NUMBER = re.compile(r"(?<![\w@/.,:\-+])(?:\(\s?\+\d{1,3}\s?\)|\+\d{1,3}|\(0\d{1,4}\)|\d)(?:[ .\-/]{0,2}(?:\(0?\d{0,4}\)[ .\-/]?)?\d){7,15}(?![\w@]|[.,:/\-]\d)")
# What stands before a phone number, and before numbers that are none, folded.
_PHONE_CUE = re.compile(r"(?:\btel\b|telef\w*|phone|mobil\w*|mobile|\bcell\b|handy|portable|movil|komork\w*|\bcall\b|reached|ring|volej\w*|volajte|zastizeni|cisle|cislo|contact\w*|kontakt\w*|contacto|appeler|joignable|llam\w*|atiendo|dzwon\w*|rufen|erreichbar|anruf\w*|fax|whatsapp|sms|тел\w*|моб\w*|телефон\w*|дзвон\w*|номер\w*|\bна\b)", re.I)
_NO_PHONE = re.compile(r"(?:invoice|faktur\w*|factur\w*|rechnung|рахунок|order|objednavk\w*|bestell\w*|auftrag|pedido|commande|zamowieni\w*|замовлення|\bico\b|\bdic\b|\bnip\b|\bregon\b|\bkrs\b|siret|siren|\bcif\b|edrpou|єдрпоу|reg\.? ?no\.?|hrb|batch|sarz\w*|charge|lot\w*|parti\w*|партія|ticket|room|vykres\w*|zeichnung|project|projekt\w*|certificate|iso|norm\w*|verze|version|reference|\bref\b|seria|serie|incident|request|iban|account|ucet|uctu|konto|kod\w*)\W{0,3}(?:no\.?|nr\.?|c\.?|n\.?o?|cislo|numer|numero)?\W{0,3}$", re.I)
# Captions of personal numbers with the form of the number after them, folded.
_IDS = re.compile(
    r"(?:\br\.\s?c\.|rodne\s+cislo|rodneho\s+cisla)\W{0,3}(?P<a>\d{6}\s?/?\s?\d{3,4})"
    r"|(?:\bob\S{3,14}\s+pr\S{1,8}k\S{0,3}zu?|\bpreukaz\w*|\bobcansk\w+|\bOP)\s?(?:c\.|cislo)?\W{0,3}(?P<b>(?:[A-Z]{2}\s?)?\d{6,9})"
    r"|(?:passport|reisepass|pasaporte|passeport|paszport\w*|cestovn\w+\s+pas\w*|паспорт\w*)\s?(?:no\.?|nr\.?|number|c\.|n\S{0,3}|№)?\W{0,3}(?P<c>[A-ZА-ЯІЇЄ]{0,3}\s?\d{6,9})"
    r"|(?:national\s+insurance|\bNI|NINO)\s?(?:no\.?|number)?\W{0,3}(?P<d>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])"
    r"|(?:personalausweis\w*|ausweis\w*)\s?(?:nr\.?|nummer|-nr\.?)?\W{0,3}(?P<e>[A-Z0-9]{8,10})"
    r"|(?:steuer\W?id\w*\.?|steueridentifikationsnummer|\bIdNr\.?)\s?(?:nr\.?)?\W{0,3}(?P<f>\d{2}\s?\d{3}\s?\d{3}\s?\d{3})"
    r"|(?:s\S{1,3}curit\S{1,3}\s+sociale|\bNIR)\W{0,3}(?P<g>[12378]\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d{2})?)"
    r"|(?:carte\s+d\S{0,3}identit\S{1,3}|\bCNI)\s?(?:n\S{0,3})?\W{0,3}(?P<h>[A-Z0-9]{9,12}|\d(?:\s?\d){8,11})"
    r"|(?:\bDNI|\bNIF)\W{0,3}(?P<i>\d{1,2}\.?\d{3}\.?\d{3}\s?-?\s?[A-Z])"
    r"|(?:\bNIE)\W{0,3}(?P<j>[XYZ]\s?-?\s?\d{7}\s?-?\s?[A-Z])"
    r"|(?:\bPESEL)\W{0,3}(?P<k>\d{11})"
    r"|(?:dow\S{1,2}d\w*\s+osobist\w*|seria\s+i\s+numer\s+dowodu)\W{0,3}(?P<l>[A-Z]{3}\s?\d{6})"
    r"|(?:РНОКПП|ІПН|ідентифікаційн\w+\s+(?:код|номер))\W{0,3}(?P<m>\d{10})"
    r"|(?:\bSSN|social\s+security)\s?(?:no\.?|number)?\W{0,3}(?P<n>\d{3}\s?-?\s?\d{2}\s?-?\s?\d{4})"
    r"|(?:\bid\s?(?:no|number|card)|identity\s+(?:card|no|number)|id-nummer|numer\s+id)\.?\s?(?:no\.?|number)?\W{0,3}(?P<o>[A-Z]{0,3}\s?\d{6,12})"
    r"|(?<![\w/.\-])(?P<p>[A-Z]{2}\d{6}[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]|\d{2}(?:0[1-9]|1[0-2]|5[1-9]|6[0-2])[0-3]\d\s?/\s?\d{4})(?![\w/\-])",
    re.I,
)
#: Pieces of the captions, folded; a line without one is only searched for bare numbers.
_ID_WORDS = "r. c|r.c|rodn|preuk|prukaz|kazu|obcan|passport|reisepass|pasaporte|passeport|paszport|pas c|pas:|паспорт|insurance|nino|ni no|ausweis|steuer|idnr|curit|nir|identit|cni|dni|nif|pesel|osobist|dowod|рнокпп|іпн|ідентиф|ssn|social sec|id no|id num|id card|id-num|numer id".split("|")
_BARE_ID = re.compile(r"(?<![\w/.\-])(?:[A-Z]{2}\d{6}[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]|\d{6}\s?/\s?\d{4})(?![\w/\-])")
_ID_HINT = re.compile(r"\d{5}|\d[\d ./\-]{6,}\d")

# A ring road, not an English word on -ring.
_RING = r"(?<![aeio])(?<![^a]u)(?<!\bst)(?<!\bsp)(?<!\bb)(?<!refer)(?<!nsfer)(?<!infer)(?<!occur)(?<!recur)ring"
# Words of street names that make a number beside them a house number, folded, and the pattern around them.
# Each pattern's words are all those that it can match by, a space standing for any white space.
_HOUSE = r"\d{1,4}(?:\s?[A-Za-z](?![A-Za-z]))?(?:\s?/\s?\d{1,4}[A-Za-z]?)?"
_STREETS = [
    ((" street", " road", " lane", " rise", " close", " avenue", " row", " drive", " way", " court", " terrace", " crescent", " gardens", " grove", " mews", " square", " hill", " walk", " place", " st.", " rd", " ave"), re.compile(rf"(?:(?:Flat|Apartment|Apt\.?|Unit)\s\d+\w?,?\s)?(?<![\w/.\-])\d{{1,4}}[A-Za-z]?,?\s(?:[A-Z][\w'’.\-]*\s){{1,3}}(?i:street|st\.|road|rd\.?|lane|rise|close|avenue|ave\.?|row|drive|way|court|terrace|crescent|gardens|grove|mews|square|hill|walk|place)(?!\w)")),
    ((" rue ", " avenue ", " boulevard ", " impasse ", " chemin ", " place ", " allee ", " quai ", " route ", " passage ", " sentier "), re.compile(rf"(?<![\w/.\-])\d{{1,4}}\s?(?:bis|ter|quater)?,?\s(?i:rue|avenue|boulevard|impasse|chemin|place|allee|quai|route|passage|sentier)\s\S+")),
    (("str. ", "stra", "gasse ", "weg ", "allee ", "platz ", "graben ", "ring ", "damm ", "ufer ", "steig "), re.compile(rf"(?<!\w)(?:[A-Z][\w\-]*er\s)?[A-Z](?:\S*(?:stra(?:ss?|[^\x00-\x7f]\S{{0,2}}|\?)e|str\.|gasse)|\S*(?:weg|allee|platz|graben|{_RING}|damm|ufer|steig))\s{_HOUSE}(?!\w)", re.I)),
    (("am ", "an der ", "im ", "zum ", "zur ", "auf dem ", "unter den ", "in der "), re.compile(rf"(?<!\w)(?:Am|An\sder|Im|Zum|Zur|Auf\sdem|Unter\sden|In\sder|AM|IM|ZUM|ZUR)\s[A-Z]\S*(?:graben|berg|bach|hof|feld|tor|markt|wald|see|garten|teich|hang|anger|muhle|hlgraben)\s{_HOUSE}(?!\w)", re.I)),
    (("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "carretera", "ronda", "travesia"), re.compile(rf"(?<!\w)(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|carretera|ronda|travesia)\s?(?:(?i:de|del|la|los|las|el)\s){{0,3}}[^\s\d,]+(?:\s[^\s\d,]+)?,?\s{_HOUSE}(?!\w)")),
    (("ul. ", "ulice ", "ulica ", "nam. ", "namesti ", "namestie ", "os. ", "osiedle ", "al. ", "aleja ", "pl. ", "plac ", "tr. ", "trida "), re.compile(rf"(?<!\w)(?i:ul\.|ulice|ulica|nam\.|namesti|namestie|os\.|osiedle|al\.|aleja|pl\.|plac|tr\.|trida)\s(?:[^\s\d,|]+\s){{1,4}}{_HOUSE}(?!\w)")),
    ((" ulica ", " ulice ", " cesta ", " ctvrt ", " namesti ", " namestie ", " trida ", " nabrezi ", " alej "), re.compile(rf"(?<!\w)[A-Z][^\s\d,|]*\s(?i:ulica|ulice|cesta|ctvrt|namesti|namestie|trida|nabrezi|alej)\s{_HOUSE}(?!\w)")),
    (("вул", "пров", "просп", "бул", "пл.", "площ", "узвіз"), re.compile(rf"(?<!\w)(?i:вул\.|вулиц[яі]|пров\.|провул\w+|просп\.|проспект\w?|бул\.|бульвар\w?|пл\.|площ[аі]|узвіз)\s[^\s\d,]+(?:\s[^\s\d,]+)?,?\s{_HOUSE}(?!\w)(?!\s?(?:кв|км|м[²2]?|га)(?!\w))")),
]
_CAPTION = re.compile(r"^\s*(?P<c>[^:|\d@]{3,40}:\s+)?(?P<s>[^|:@]{3,60}?)(?P<t>,\s[^\d,|:@]{3,30})?\s*$")
_HAS_HOUSE = re.compile(rf"(?<![\w/.\-]){_HOUSE}(?![\w\d])")
_ADDRESS_CUE = re.compile(r"(?:address|adres\w*|bydlis\w*|bydlim|bydli\w*|pobyt|wohn\w*|anschrift|domicil\w*|mieszka\w*|zamieszk\w*|byvam|bydlisko|vivo|habite|lived?|адрес\w*|мешка\w*|прожива\w*)", re.I)

_DIGIT = re.compile(r"\d")
_NINE = re.compile(r"\d(?:[ .\-/()]{0,4}\d){8}")
_PIPE = re.compile(r"\||(?m:^[^\n:|\d@]{3,40}: [^\n]*\d)")
_WHITE = {o: " " for o in range(0x3001) if chr(o).isspace() and o != 10}
_TOKEN = re.compile(r"(?:[A-ZА-ЯҐЄІЇ][^\W\d_]*|[^\W\d_]*[A-ZА-ЯҐЄІЇ][^\W\d_]*)(?:['’\-][^\W\d_]+)*")
_INITIAL = re.compile(r"(?<!\w)[A-ZА-ЯҐЄІЇ]\.\s?$")


@lru_cache(maxsize=1)
def _fold() -> dict[int, str]:
    """Letters without their accents, one for one."""
    out: dict[int, str] = {}
    for o in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(o))[0]
        if base.isascii():
            out[o] = base
    return out | {ord("ß"): "s", ord("ł"): "l", ord("Ł"): "L", ord("đ"): "d", ord("Đ"): "D", ord("ø"): "o", ord("Ø"): "O", ord("’"): "'", ord("–"): "-", ord("—"): "-", ord("‑"): "-"}


@lru_cache(maxsize=1)
def _rewrite() -> dict[str, str]:
    return {c: to for c, to in (compat() | SIGNS).items()} | {chr(o): " " for o in SPACES} | {chr(o): "" for o in INVISIBLE} | {"\t": " "}


_ODD = re.compile("[" + re.escape("".join(map(chr, SPACES))) + "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\U000e0000-\U000e007f\u0300-\u036f\ufb00-\ufb06\uff01-\uffee\U0001d400-\U0001d7ff\t]")
_OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ԯԱ-֏]")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ϿЀ-ԯԱ-֏]|[Ͱ-ϿЀ-ԯԱ-֏][A-Za-zÀ-ɏ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT_WORDS = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, DIGITS), key=len, reverse=True)) + r")(?:[\s\-]+(?:" + "|".join(sorted(map(re.escape, DIGITS), key=len, reverse=True)) + r")){6,}(?![^\W_])", re.I)


_FOLDED = re.compile("[À-ɏ’–—‑]")
_SAME_LETTER = str.maketrans("ıſ", "is")


@lru_cache(maxsize=1)
def _digit_words() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in DIGITS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _spelled(text: str) -> bool:
    """Whether the text holds as many whole digit words as ``_DIGIT_WORDS`` asks for."""
    low, n = text.lower().translate(_SAME_LETTER), 0
    for end, size in _digit_words().iter(low):
        if (end < size or not low[end - size].isalnum()) and not low[end + 1 : end + 2].isalnum():
            n += 1
            if n == 7:
                return True
    return False


def transduce(text: str) -> tuple[str, list[int] | None]:
    """(rewritten text, source place of each of its characters); the places are None where they are the same."""
    if not text.isascii() and (_ODD.search(text) or _OTHER_SCRIPT.search(text) and _MIXED.search(text)):
        out, back, at = [], [], 0
        table = _rewrite()
        for m in _ODD.finditer(text):
            i = m.start()
            to = table.get(text[i], "")  # a combining accent has no form of its own
            out += [text[at:i], to]
            back += [*range(at, i), *[i] * len(to)]
            at = i + 1
        out.append(text[at:])
        back += range(at, len(text))
        joined = "".join(out)
        for m in _LETTERS.finditer(joined):
            w = m.group(0)
            if not w.isascii() and any(c in FOREIGN for c in w) and any(c < "ɐ" for c in w):
                joined = joined[: m.start()] + "".join([FOREIGN.get(c, c) if len(FOREIGN.get(c, c)) == 1 else c for c in w]) + joined[m.end() :]
        text, places = joined, back
    else:
        places = None
    if not text.isascii():
        fold = _fold()
        text = _FOLDED.sub(lambda m: fold.get(ord(m.group(0)), m.group(0)), text)
    if _spelled(text) and (m := _DIGIT_WORDS.search(text)) is not None:
        places = places if places is not None else list(range(len(text)))
        while m:
            words = list(re.finditer(r"[^\s\-]+", m.group(0)))
            digits = "".join([DIGITS[w.group(0).lower().translate(_SAME_LETTER)] for w in words])
            text = text[: m.start()] + digits + text[m.end() :]
            places = places[: m.start()] + [places[m.start() + w.start()] for w in words] + places[m.end() :]
            m = _DIGIT_WORDS.search(text, m.start() + len(digits))
    return text, places


_CONTACT_STREET = re.compile(rf"(?:\D{{3,40}}?:\s)?([^\d,|]{{4,40}}?),?\s{_HOUSE}(?:,?\s[^,\d]{{0,4}}\.?\s?\d*\s?[^,\d]{{0,5}})?,\s[^\d,]+")
_STREET_NUMBER = re.compile(rf",?\s{_HOUSE}(?!\w)", re.I)


def name_parts(name: str) -> list[tuple[str, str]]:
    """(first or last, part) of a name of two words; none of others."""
    plain = transduce(name)[0]
    tokens = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", plain)
    if len(tokens) != 2:
        return []
    a, b = tokens
    turned = "," in plain or a.isupper() and len(a) > 2 and not b.isupper()
    given, family = (b, a) if turned else (a, b)
    return [("first", given.lower()), *(("last", part) for part in {family.lower(), *re.split(r"['’\-]", family.lower())})]


def contact_streets(text: str) -> list[tuple[str, str]]:
    """(street, its name) of every contact line."""
    out = []
    for line in text.split("\n"):
        if "|" in line:
            first = transduce(line.split("|")[0].strip())[0]
            if "@" not in first and not _AT_HINT.search(first) and (m := _CONTACT_STREET.fullmatch(first)) and m.group(1).isascii():
                out.append(("street", m.group(1).lower()))
    return out


class Lexicon:
    """Names and street names, folded to small letters without accents, from their counts."""

    def __init__(self, first: dict[str, int], last: dict[str, int], streets: dict[str, int]):
        #: A token is a given name if it mostly stands in a given name's place.
        self.given = {t for t, n in first.items() if len(t) >= 3 and n > 2 * last.get(t, 0)} - COMMON_WORDS
        self.names = self.given | {t for t, n in last.items() if len(t) >= 3} - COMMON_WORDS
        self.streets = sorted(s for s, n in streets.items() if n >= 2)
        self._hits = None

    def __getstate__(self):
        return self.__dict__ | {"_hits": None}

    def hits(self) -> ahocorasick.Automaton:
        """Where a line needs a closer look: names (n), the words of streets (group of ``_STREETS``) and streets (s with the length)."""
        if self._hits is None:
            a = ahocorasick.Automaton()
            kinds: dict[str, set] = defaultdict(set)
            for w in self.names:
                kinds[w].add("n")
            for w in self.streets:
                kinds[w].add(("s", len(w)))
            for w in _ID_WORDS:
                kinds[w].add("i")
            for k, (hints, _) in enumerate(_STREETS):
                for w in hints:
                    kinds[w].add(k)
            for w, k in kinds.items():
                a.add_word(w, k)
            a.add_word("\x01", set())
            a.make_automaton()
            self._hits = a
        return self._hits


COMMON_WORDS = set("the and von van der die das ist les des une por con para pan pani mr mrs dr ing mgr".split())


def _addresses(line: str, hints: set, lex: Lexicon) -> list[tuple[int, int]]:
    found = []
    for k in hints:
        if isinstance(k, tuple) and k[0] == "s":
            a, b = k[1:]
            if "\x00" not in line[a:b] and not (a and (line[a - 1].isalnum() or line[a - 1] == "_")) and (m := _STREET_NUMBER.match(line, b)):
                found.append((a, m.end()))
        elif isinstance(k, int):
            found += [m.span() for m in _STREETS[k][1].finditer(line)]
    # A contact line or a captioned line: street and house number, then a town.
    first = line.split("|")[0]
    if not found and len(first) < 150 and "," in first and (m := _CAPTION.match(first)) and m.group("t") and (h := _HAS_HOUSE.search(m.group("s"))):
        cue = "|" in line or m.group("c") and _ADDRESS_CUE.search(m.group("c"))
        if cue and len(_LETTERS.findall(m.group("s"))) >= 1 and len(h.group(0)) <= 9 and not re.search(r"\d{5}", m.group("s")):
            found.append((m.start("s"), m.end("s")))
    return _merge(found)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _known(token: str, names: set[str]) -> bool:
    low = token.lower()
    return low in names or ("-" in low or "'" in low or "’" in low) and any(p in names for p in re.split(r"['’\-]", low))


def _names(line: str, lex: Lexicon) -> list[tuple[int, int]]:
    tokens = [(m.start(), m.end(), m.group(0)) for m in _TOKEN.finditer(line)]
    if not tokens:
        return []
    known = [_known(t, lex.names) for _, _, t in tokens]
    if not any(known):
        return []
    given = [_known(t, lex.given) for _, _, t in tokens]
    shout = line.upper() == line
    found, i, n = [], 0, len(tokens)
    while i < n:
        a, b, t = tokens[i]
        if known[i] and (m := _INITIAL.search(line, max(0, a - 4), a)) and not given[i]:
            found.append((m.start(), b))
            i += 1
            continue
        if i + 1 < n:
            c, d, u = tokens[i + 1]
            gap = line[b:c]
            beside = gap == " " or gap == ", "
            if beside and known[i] and known[i + 1] and (gap == " " or given[i + 1] and not given[i]) and (given[i] or given[i + 1]):
                found.append((a, d))
                i += 2
                continue
            if gap == " " and given[i] and not known[i + 1] and not shout and len(u) >= 3 and u[0].isupper() and u.lower() not in COMMON_WORDS:
                found.append((a, d))
                i += 2
                continue
            if gap == ", " and known[i] and not given[i] and not known[i + 1] and _odd_word(line, c):
                found.append((a, d))
                i += 2
                continue
            if gap in (" ", ", ") and given[i + 1] and not known[i] and len(t) >= 3 and (t.isupper() and not shout and len(t) >= 4 or gap == ", " and a == 0 or _odd_word(line, a) or _odd_word(line, b - 1)) and not (i + 2 < n and known[i + 2] and line[d : tokens[i + 2][0]] == " "):
                start = line.rfind(" ", 0, a) + 1
                found.append((start if _odd_word(line, a) else a, d))
                i += 2
                continue
        # A known family name and an initial after it.
        if known[i] and not given[i] and (m := re.match(r",?\s[A-ZА-ЯҐЄІЇ]\.(?!\w)", line[b : b + 5])):
            found.append((a, b + m.end()))
        # A given name before a word that a wrong decoding has cut up.
        elif given[i] and (m := re.match(r"\s(\S{3,30})", line[b : b + 32])) and re.search(r"[^\x00-\x7fЀ-ӿ]|\?\w", m.group(1)) and (i + 1 >= n or tokens[i + 1][0] <= b + 1 + len(m.group(1))):
            found.append((a, b + m.end()))
        i += 1
    return _merge(found)


def _odd_word(line: str, at: int) -> bool:
    """Whether the piece around the place has characters that no alphabet explains."""
    start = line.rfind(" ", 0, at) + 1
    end = line.find(" ", at)
    return re.search(r"[^\x00-\x7fЀ-ӿ]|\w\?\w", line[start : end if end >= 0 else len(line)]) is not None


def _line(line: str, hints: set, lex: Lexicon, phones: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    masked = line

    def take(a: int, b: int, kind: str) -> None:
        nonlocal masked
        if masked[a:b].strip("\x00"):
            spans.append((a, b, kind))
            masked = masked[:a] + "\x00" * (b - a) + masked[b:]

    if _AT_HINT.search(line):
        for m in _EMAIL.finditer(line):
            if re.search(r"@\d|@[^.]*/", m.group(0)) is None:
                take(m.start(), m.end(), "email")
    if _ID_HINT.search(masked) and ("i" in hints or _BARE_ID.search(masked)):
        for m in _IDS.finditer(masked):
            g = m.lastgroup
            if g and not (g == "p" and _NO_PHONE.search(masked[max(0, m.start() - 30) : m.start()])):
                if g == "e" and not re.search(r"\d{4}", m.group(g)):
                    continue
                take(m.start(g), m.end(g), "id_number")
    if _DIGIT.search(masked):
        for a, b in _addresses(masked, hints, lex):
            take(a, b, "address")
    if _NINE.search(masked):
        for m in _NUMBER.finditer(masked):
            number = m.group(0).rstrip(" .-/")
            digits = sum(c.isdigit() for c in number)
            if not 9 <= digits <= 15:
                continue
            before, after = masked[: m.start()], masked[m.start() + len(number) :]
            if number[0] in "+(" or number.startswith("00") and digits >= 11 or _digits(number) in phones:
                take(m.start(), m.start() + len(number), "phone")
                continue
            if _NO_PHONE.search(before[-28:]):
                continue
            alone = before.rstrip().endswith("|") or not before.strip(" \x00|")
            alone = alone and (after.lstrip(" .").startswith("|") or not after.strip(" \x00|."))
            near = before[-50:]
            for cut_at in (near.rfind("|"), *[m.start() for m in _DIGIT.finditer(near)][-1:]):
                if cut_at >= 0:
                    near = near[min(cut_at + 1, len(near)) :] if cut_at < len(near) else near
            if alone or _PHONE_CUE.search(near) or re.search(r"(?:\b(?:at|on|na|pod|unter|al|au|le|to)\s)$", before[-12:], re.I) and re.search(r"^0|[ ./\-]", number):
                take(m.start(), m.start() + len(number), "phone")
    for k in sorted(k for k in hints if isinstance(k, tuple) and k[0] in ("name", "email")):
        if "\x00" not in masked[k[1] : k[2]]:
            take(k[1], k[2], k[0])
    if "n" in hints:
        for a, b in _names(masked, lex):
            take(a, b, "name")
    return spans


def _own(known: str) -> re.Pattern | None:
    """Pattern of a name or address as it stands; None for one without letters."""
    words = [re.escape(w) for w in re.split(r"\s+", transduce(known)[0].strip()) if w]
    return re.compile(r"(?<!\w)" + r"[^\S\n]+".join(words) + r"(?!\w)", re.I) if words and _LETTERS.search(known) else None


def _digits(number: str) -> str:
    """The last nine digits of a number, which are the same in all notations; empty for fewer."""
    digits = "".join([c for c in number if c.isdigit()])
    return digits[-9:] if len(digits) >= 9 else ""


def find(text: str | None, lex: Lexicon, own: list[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item in the source text, in order. own: what the text's own identity has, each as
    "name:…" or "email:…", looked for as it stands, or "phone:…", looked for in any notation."""
    if not text:
        return []
    plain, places = transduce(text)
    lines = plain.split("\n")
    ends, at = [], 0
    for line in lines:
        at += len(line) + 1
        ends.append(at)
    hints: dict[int, set] = defaultdict(set)
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join([c.lower()[0] for c in plain])
    for end, kinds in lex.hits().iter("\n" + low.translate(_WHITE)):
        k = bisect_right(ends, end - 1)
        for kind in kinds:
            if isinstance(kind, tuple):
                at = end - (ends[k - 1] if k else 0)
                kind = ("s", at - kind[1], at)
            hints[k].add(kind)
    phones = set()
    for known in own or ():
        what, _, value = known.partition(":")
        if what == "phone":
            phones.add(_digits(value))
            continue
        for m in rx.finditer(plain) if (rx := _own(value)) else ():
            if what == "email" or not m.group(0)[0].islower():
                k = bisect_right(ends, m.start())
                at = ends[k - 1] if k else 0
                hints[k].add((what, m.start() - at, m.end() - at))
    phones = frozenset(phones - {""})
    for rx in (_ID_HINT, _AT_HINT):
        for m in rx.finditer(plain):
            hints[bisect_right(ends, m.start())].add("x")
            if "\n" in m.group(0):
                hints[bisect_right(ends, m.end() - 1)].add("x")
    for m in _PIPE.finditer(plain):
        hints[bisect_right(ends, m.start())].add("x")
    out = []
    for k in sorted(hints):
        if k < len(lines) and (any(not isinstance(x, int) for x in hints[k]) or _DIGIT.search(lines[k])):
            at = ends[k] - len(lines[k]) - 1
            out += [(at + a, at + b, kind) for a, b, kind in _line(lines[k], hints[k], lex, phones)]
    if places is not None:
        out = [(places[a], _source_end(text, plain, places, b), k) for a, b, k in out]
    return sorted(out)


def _source_end(text: str, plain: str, places: list[int], end: int) -> int:
    """Where an item that ends before ``end`` of the rewritten text ends in the source; a spelled digit ends with its word."""
    at = places[end - 1]
    spelled = plain[end - 1].isdigit() and text[at].isalpha() and text[at].isascii()
    at += 1
    while spelled and at < len(text) and (text[at].isalpha() or text[at] == "'"):
        at += 1
    return at


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """The text with each item replaced by its placeholder; all else stays."""
    out, at = [], 0
    for a, b, k in items:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def fit(scans: DataFrame, extractions: DataFrame, text: str = "visible_text") -> Lexicon:
    """The lexicons of all known identities' names and of all contact lines, counted where they lie. Fails if there are
    more than ``LEXICON_MOST`` distinct parts and streets."""

    def counter(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    n.update(of(t))
                if len(n) > 50_000:
                    yield rows(n)
                    n = Counter()
            if n:
                yield rows(n)

        def rows(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["role", "word", "n"])

        return run

    schema = "role string, word string, n bigint"
    name = F.col("identity_info.full_name")
    lines = F.array_join(F.regexp_extract_all(text, F.lit(r"[^\n]*\|[^\n]*"), F.lit(0)), "\n")
    names = extractions.where(F.length(name) > 3).select(name.alias("t")).mapInArrow(counter(name_parts), schema)
    streets = scans.where(F.instr(text, "|") > 0).select(lines.alias("t")).mapInArrow(counter(contact_streets), schema)
    words = names.unionByName(streets).groupBy("role", "word").agg(F.sum("n").alias("n")).where("role <> 'street' OR n >= 2")
    got = words.limit(LEXICON_MOST + 1).collect()
    if len(got) > LEXICON_MOST:
        raise ValueError(f"more than {LEXICON_MOST} distinct name parts and streets")
    by: dict[str, dict[str, int]] = {"first": {}, "last": {}, "street": {}}
    for r in got:
        by[r.role][r.word] = r.n
    return Lexicon(by["first"], by["last"], by["street"])


def own_items(extractions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(scan_id, own): of each scan what its own identities have and ``find`` may not see without: names that the lexicon
    doesn't give as a whole, addresses that no pattern meets, and phone numbers, which may stand without a caption."""
    shared = extractions.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = []
            for known in b.column(1).to_pylist():
                what, _, value = known.partition(":")
                rest.append(bool(_digits(value)) if what == "phone" else not any(k == what and a == 0 and e == len(value) for a, e, k in find(value, shared.value)))
            yield b.filter(pa.array(rest, pa.bool_()))

    fields = extractions.schema["identity_info"].dataType.fieldNames()
    lists = {"name": F.array("identity_info.full_name")} | {k: F.col(f"identity_info.{f}") for k, f in (("email", "emails"), ("phone", "phones")) if f in fields}
    marked = lambda k, c: F.transform(c, lambda v: F.concat(F.lit(f"{k}:"), F.trim(v)))
    identity = F.array(*[marked(k, c) for k, c in lists.items()])
    known = F.explode(F.flatten(F.filter(identity, lambda v: v.isNotNull())))
    given = extractions.where(F.col("scan_id").isNotNull()).select("scan_id", known.alias("own")).where(F.length("own") > 8).distinct()
    kind = extractions.schema["scan_id"].dataType.simpleString()
    return given.mapInArrow(run, f"scan_id {kind}, own string").groupBy("scan_id").agg(F.collect_set("own").alias("own"))


def items(scans: DataFrame, lexicon: Lexicon, key: str = "scan_id", text: str = "visible_text", redacted: bool = False, own: DataFrame | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of every item, or with ``redacted`` (key, text) with the items replaced.

    Places are code points of the source, from 0. Null and empty texts have no items and stay as they are; repeated rows
    give repeated rows; whole texts are read; an empty table gives an empty one. Other columns aren't read. own: (key,
    own), what to look for in the row's text as in ``find``, at most a row a key.
    """
    shared = scans.sparkSession.sparkContext.broadcast(lexicon)
    kind, joined = scans.schema[key].dataType.simpleString(), own is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(1).to_pylist()
                found = [find(t, lex, o) for t, o in zip(texts, b.column(2).to_pylist() if joined else [None] * len(texts))]
                if redacted:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if t is None else redact(t, f) for t, f in zip(texts, found)], pa.string())], [key, text])
                else:
                    of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                    flat = [x for f in found for x in f]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array([x[2] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], [key, "kind", "start_pos", "end_pos"])

    schema = f"`{key}` {kind}, `{text}` string" if redacted else f"`{key}` {kind}, kind string, start_pos bigint, end_pos bigint"
    if own is None:
        return spread(scans.select(key, text)).mapInArrow(run, schema)
    return spread(scans.select(key, text), key).join(own.select(key, "own"), key, "left").mapInArrow(run, schema)


def found(scans: DataFrame, extractions: DataFrame) -> DataFrame:
    """(scan_id, kind, start_pos) of every item, each once however often its row came."""
    lexicon = fit(scans, extractions)
    return items(scans, lexicon, own=own_items(extractions, lexicon)).where(F.col("scan_id").isNotNull()).select("scan_id", "kind", "start_pos").distinct()


def redacted(scans: DataFrame, extractions: DataFrame) -> DataFrame:
    """(scan_id, visible_text) of every scan with its personal data replaced by typed placeholders."""
    lexicon = fit(scans, extractions)
    return items(scans, lexicon, redacted=True, own=own_items(extractions, lexicon))
