"""Template residue, filler and error-page text.

One multi-pattern automaton over the folded text finds the phrases of error pages, script notices and filler in eight
languages, the words of dummy Latin, and the openers of unfilled placeholders. Message phrases count by their coverage:
a text is a message when the sentences with such a phrase make up most of it. Filler counts by its coverage of a
sentence, and a placeholder by its place: one that stands where content belongs leaves the document unfinished, however
long it is; one beside a word for templates, code and the like is a mention. An exact look follows the automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: Share of a text's letters and digits that message sentences must make up for the text to be a message.
MESSAGE_SHARE = 0.5
#: Least number of dummy Latin words in a row of which most begin like the well-known ones.
LATIN_RUN = 6
LATIN_SHARE = 0.6

# Phrases of failure messages, folded (lower case, no accents).
ERRORS = """
page not found|page could not be found|could not be found on this server|was not found on this server|the requested page|the requested url
404 not found|410 gone|403 forbidden|502 bad gateway|503 service unavailable|500 internal server error|504 gateway timeout|bad gateway|internal server error
not found|forbidden|gone
access denied|you do not have permission|you are not authorized|permission denied|unauthorized access
session has expired|your session expired|please sign in again|please log in again|sign in to continue
service temporarily unavailable|temporarily unavailable|maintenance window|under maintenance|scheduled maintenance|request id
something went wrong|our team has been told|an error occurred|an unexpected error|unexpected error|please try again later|try again later
could not be converted|could not be loaded|could not be opened|failed to load|conversion failed|unable to open|cannot be displayed
too many requests|downloads per minute|rate limit|limit reached
has been removed or is no longer|no longer shared|no longer available
traceback (most recent call last)|, line |valueerror:|typeerror:|keyerror:|exception in thread|stack trace|nullpointerexception|segmentation fault
upstream timed out|reading response header|connection timed out|connection refused|connection reset
stranka nenalezena|stranka nebyla nalezena|stranka neexistuje|zkontrolujte prosim adresu|nemate opravneni|pristup odepren|pristup zamitnut|platnost prihlaseni vyprsela|prihlaste se prosim znovu|relace vyprsela|sluzba je docasne nedostupna|docasne nedostupn|dokument se nepodarilo|nepodarilo se|kod chyby|doslo k chybe|zkuste to pozdeji|soubor byl odstranen
sa nenasla|stranka neexistuje|nemate opravnenie|pristup zamietnuty|platnost prihlasenia uplynula|prihlaste sa znova|sluzba je docasne nedostupna|dokument sa nepodarilo|nepodarilo sa|skuste to neskor|vyskytla sa chyba|subor bol odstraneny
wurde nicht gefunden|seite nicht gefunden|zugriff verweigert|keine berechtigung|die sitzung ist abgelaufen|sitzung abgelaufen|melden sie sich erneut an|wegen wartung nicht erreichbar|nicht erreichbar|konnte nicht geladen werden|konnte nicht geoffnet werden|konnte nicht umgewandelt werden|es ist ein fehler aufgetreten|versuchen sie es spater|datei wurde entfernt|zu viele anfragen
est introuvable|page introuvable|page non trouvee|acces refuse|vous n'avez pas l'autorisation|votre session a expire|veuillez vous reconnecter|temporairement indisponible|service indisponible|n'a pas pu etre converti|n'a pas pu etre ouvert|n'a pas pu etre charge|une erreur est survenue|veuillez reessayer|fichier a ete supprime|trop de requetes
no se encuentra la pagina|pagina no encontrada|acceso denegado|no tiene permiso|la sesion ha caducado|inicie sesion de nuevo|no disponible temporalmente|temporalmente no disponible|servicio no disponible|no se pudo abrir|no se pudo convertir|no se pudo cargar|se ha producido un error|intentelo mas tarde|demasiadas solicitudes|archivo ha sido eliminado
nie znaleziono strony|strona nie istnieje|nie znaleziono|brak dostepu|odmowa dostepu|nie masz uprawnien|sesja wygasła|sesja wygasla|zaloguj sie ponownie|chwilowo niedostepn|tymczasowo niedostepn|przerwa techniczna|nie udało sie|nie udalo sie|wystapił bład|wystapil blad|sprobuj pozniej|zbyt wiele zadan|plik został usuniety|plik zostal usuniety
сторінку не знайдено|сторінки не знайдено|не знайдено|доступ заборонено|немає дозволу|немає прав|сеанс завершено|сеанс завершився|термін дії сеансу|увійдіть знову|увійдіть ще раз|тимчасово недоступн|сервіс недоступний|не вдалося|сталася помилка|спробуйте пізніше|файл видалено|забагато запитів|код помилки
"""
# Phrases of notices that scripts are required, folded.
SCRIPTS = """
enable javascript|turn on javascript|javascript is disabled|javascript is turned off|requires javascript to|needs javascript|without javascript|javascript must be enabled
needs scripts and cookies|scripts and cookies|turn them on and reload|without script support|check that scripts are allowed|scripts are allowed for|scripts must be allowed|if nothing happens
checking your browser|verifying your browser|browser check
zapnete v prohlizeci|zapnete javascript|povolte javascript|povolene skripty|bez skriptu|povolte skripty|kontrolujeme vas prohlizec
zapnite javascript|povolte javascript|povolene skripty|povolte skripty|bez skriptov
aktivieren sie javascript|javascript aktivieren|ohne skripte|ohne javascript|skripte erlauben|skripte aktivieren
activer javascript|activez javascript|sans javascript|autoriser les scripts|autorisez les scripts
active javascript|habilite javascript|activar javascript|sin javascript|permita los scripts
właczyc javascript|włacz obsługe skryptow|wlacz obsluge skryptow|włacz javascript|wlacz javascript|bez obsługi skryptow|zezwol na skrypty
увімкніть javascript|увімкніть скрипти|увімкнути javascript|без скриптів|дозвольте скрипти
"""
# Filler that stands in for content, folded.
FILLERS = """
sample text goes here|your text here|text goes here|insert text here|add your text|placeholder paragraph|placeholder text|dummy text|this is a sample text|replace before publishing|replace this text|body text level|click to add text|type your text|content coming soon|lorem ipsum dolor
zde bude text|sem vlozte text|zde doplnte text|vzorovy text|ukazkovy text|text bude doplnen
sem pride text|tu bude text|sem vlozte text|vzorovy text
hier steht spater|hier steht demnachst|hier folgt der text|hier kommt der text|platzhaltertext|blindtext|beispieltext
texte provisoire|texte a remplacer|votre texte ici|inserez votre texte|texte d'exemple|texte a venir
aqui va el texto|aqui ira el texto|texto de ejemplo|texto provisional|inserte aqui el texto|texto de relleno|texto pendiente
tu bedzie opis|tu bedzie tekst|tutaj bedzie|tekst zastepczy|przykładowy tekst|przykladowy tekst|wstaw tutaj tekst
тут буде текст|тут буде опис|тут з'явиться|зразок тексту|вставте текст|текст-заповнювач
"""
# The words of the well-known dummy Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum amor vitae quam"
).split()
# Words for the fields that templates leave blank, folded.
FIELDS = (
    "name surname firstname lastname first_name last_name full_name candidate candidate_name applicant company company_name employer office city office_city town address street "
    "position job_title title salary wage date start_date end_date today day month year recruiter manager contact phone email e-mail website url signature reference amount number text "
    "jmeno prijmeni jmeno_prijmeni spolecnost firma pozice datum mesto adresa plat telefon podpis doplnit doplnte vyplnit vyplnte nazev meno priezvisko pozicia doplnte doplnit "
    "anrede vorname nachname position stelle gehalt ort stadt strasse unternehmen datum ansprechpartner eintragen einsetzen einfugen "
    "nom prenom poste societe entreprise ville salaire lieu votre inserer completer a_completer "
    "nombre apellido apellidos empresa puesto fecha ciudad salario su_nombre insertar completar "
    "imie nazwisko imie_nazwisko stanowisko miasto pensja wpisz wpisac uzupełnij uzupelnij data "
    "імя прізвище посада компанія дата місто зарплата вкажіть впишіть your insert enter placeholder xxx tbd tbc todo"
).split()
# Words, folded, for things that hold placeholders and filler rightly: templates, layouts, code and its faults.
ABOUT = re.compile(
    r"(?:templates?|placeholders?|mail merges?|mock-?ups?|wireframes?|layouts?|scripts?|bugs?|code|syntax|variables?|brackets?|braces|printed|rendered"
    r"|sablon\w*|skript\w*|navrh\w*|navrz\w*|kod(?:u|em)?|chyb(?:a|u|y)|promenn\w*|zavork\w*|premenn\w*|zatvork\w*"
    r"|vorlagen?|platzhaltern?|skripten?|fehler|klammern?|entwurfen?|plantillas?|marcador(?:es)?|codigo|modeles?|gabarits?|accolades?|maquettes?"
    r"|szablon\w*|skrypt\w*|blad|kodu|zmienn\w*|nawias\w*|шаблон\w*|скрипт\w*|макет\w*|дужк\w*|змінн\w*)(?!\w)"
)
#: Words before and after a place among which one of those makes it a mention.
NEAR = 4
#: Share of a sentence's letters and digits that filler phrases must make up for it to be filler.
FILLER_SHARE = 0.3
_ENVIRONMENT = {"HOME", "PATH", "USER", "PWD", "SHELL", "LANG", "TMPDIR", "JAVA_HOME"}

_ID = r"[^\W\d_][\w]*(?:[.\- ][\w]+){0,3}"
_BRACED = re.compile(
    rf"\{{\{{\s*[#/]?\s*{_ID}\s*\}}\}}|[#$]\{{\s*({_ID})\s*\}}|\{{!?\s*[^\W\d_][\w.\-]*\s*\}}|(?:\{{\d\}}\s*){{1,4}}|\[\[\s*{_ID}\s*\]\]|<<\s*{_ID}\s*>>|<%=?\s*{_ID}\s*%>|@@[\w.\-]+@@|\$[^\W\d_][\w.\-]*\$|%[A-Z][A-Z_.\-\d]+%|__[A-Z][A-Z_.\-\d]*__|\[object Object\]"
)
_BRACKET = re.compile(r"\[([^\[\]\n]{2,60})\]|<([^<>\n=/]{2,60})>|«([^«»\n]{2,40})»|\(([^()\n]{4,60})\)|‹([^‹›\n]{2,40})›")
_BLANK = re.compile(r"_{5,}|\bX{4,}\b|\b(?:T\s?B\s?[CD])(?:\s+TB[CD]){1,}\b|\bTODO\s*:|\bundefined undefined\b|\bNaN\b|Sir/Madam\s+NULL\b|\bNULL\b|\.{8,}|…{4,}")
_SPACED = re.compile(r"T\sB")
_REPEATED = re.compile(r"(?<!\w)([^\W_]{2,10})(?:\s+\1){5,}(?!\w)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+|<[^<>]{1,200}>")
_SPACE = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_COUNTED = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W\d_]+")
_NEAR_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


#: Combining marks of Latin, Greek and Cyrillic, and a range that holds all others.
_MARKS, _OTHER_MARKS = re.compile("[\u0300-\u036f]"), re.compile("[\u0483-\u0489\u0591-\u1dff\u20d0-\u20f0\u2cef-\U0010ffff]")


def fold(text: str) -> str:
    """Lower case without accents; line feeds stay, other white space becomes one space."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _OTHER_MARKS.search(text):
            text = "".join([c for c in text if not unicodedata.combining(c)])
    return _SPACE.sub(" ", text.lower())


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrase -> kind: error, script, filler, latin (beginnings of dummy Latin words), open (placeholder openers)."""
    a = ahocorasick.Automaton()
    for kind, table in (("error", ERRORS), ("script", SCRIPTS), ("filler", FILLERS)):
        for phrase in table.replace("\n", "|").split("|"):
            if phrase.strip():
                a.add_word(fold(phrase.lstrip()), (kind, len(phrase)))
    for w in LATIN:
        if len(w) >= 4:
            a.add_word(" " + w[:4], ("latin", 0))
    for w in ("{", "[", "<", "«", "‹", "@@", "$", "%", "__", "xxxx", "todo", "tbc", "tbd", "null", "undefined", "nan", "....", "(", "…"):
        a.add_word(w, ("open", 0))
    a.make_automaton()
    return a


_LATIN_START = {w[:4] for w in LATIN if len(w) >= 4}
#: Message phrases that ordinary sentences also hold count only in short sentences.
_SHORT_ONLY = {"not found", "forbidden", "gone", "request id", ", line ", "nicht erreichbar", "не вдалося", "не знайдено", "nie znaleziono", "nepodarilo se", "nepodarilo sa", "nie udalo sie", "sa nenasla", "est introuvable", "the requested page"}


def _latin_run(folded: str) -> bool:
    """Whether a run of dummy Latin stands in the text."""
    for sentence in re.split(r"[.!?\n]", folded):
        words = _WORD.findall(sentence)
        if len(words) < LATIN_RUN:
            continue
        hits = [w[:4] in _LATIN_START for w in words]
        run = sum(hits[:LATIN_RUN])
        for i in range(LATIN_RUN, len(hits) + 1):
            if run >= LATIN_SHARE * LATIN_RUN and run >= 4:
                long = sum(len(w) >= 4 for w in words[i - LATIN_RUN : i])
                if long >= 4 and sum(hits) >= 0.4 * len(hits):
                    return True
            if i < len(hits):
                run += hits[i] - hits[i - LATIN_RUN]
    return False


def _field_like(inside: str) -> bool:
    """Whether the text between single brackets names a field to fill in."""
    text = inside.strip()
    if not text or text[0].isdigit():
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:[_.\-][A-Z0-9]+)*", text) and len(text) >= 3 and any(p in FIELDS for p in [fold(text), *re.split(r"[_.\-]", fold(text))]):
        return True
    words = re.split(r"[\s_.\-:,]+", fold(text).strip())
    if len(words) > 6:
        return False
    return any(w in FIELDS for w in words)


def placeholders(text: str) -> list[str]:
    """The unfilled placeholders that stand where content belongs."""
    found = []
    braced = any(c in text for c in "{[<@$%_")
    blank = any(c in text for c in ("_____", "XXXX", "TB", "TODO", "undefined undefined", "NaN", "NULL", "." * 8, "…" * 4)) or _SPACED.search(text)
    for rx in (*[_BRACED] * braced, _BRACKET, *[_BLANK] * bool(blank)):
        for m in rx.finditer(text):
            if rx is _BRACED and m.group(1) in _ENVIRONMENT:
                continue
            if rx is _BRACKET:
                inside = next(g for g in m.groups() if g is not None)
                words = fold(inside).split()
                if m.group(4) is not None:
                    if not (re.search(r"\b(eintragen|einsetzen|einfugen|doplnte|doplnit|vyplnte|insert|fill in|wpisz|uzupelnij|inserer|completer|completar|insertar|вкажіть|впишіть)\b", fold(inside)) or (words[0] in ("name", "date", "signature", "company") and text[max(0, m.start() - 6) : m.start()].strip().endswith("_"))):
                        continue
                elif m.group(2) is not None and (inside.lower().split()[0].strip("!") in _TAGS or "@" in inside or "://" in inside):
                    continue
                elif not _field_like(inside):
                    continue
            if not _mentioned(text, m.start(), m.end()):
                found.append(m.group(0))
    return found


#: Markup that is no placeholder.
_TAGS = set("html head body title h1 h2 h3 h4 h5 h6 hr br p div span a b i u em strong ul ol li table tr td th thead tbody noscript script style meta link img pre code center font form input button !doctype".split())


def judge(text: str | None) -> tuple[str | None, float]:
    """(kind, coverage): kind is error, script, filler, placeholder or None; coverage the share of message sentences.

    A null, empty or blank text is no case.
    """
    if not text or not text.strip():
        return None, 0.0
    folded = fold(text)
    hits: dict[str, list[tuple[int, str]]] = {}
    padded = " " + folded.replace("\n", " \n ")
    for end, (kind, length) in automaton().iter(padded):
        hits.setdefault(kind, []).append((end, padded[end - length + 1 : end + 1] if length else ""))
    share, kind = 0.0, None
    if "error" in hits or "script" in hits:
        places = sorted((e, k, p) for k in ("error", "script") for e, p in hits.get(k, ()))
        total = covered = at = 0
        kinds: dict[str, int] = {}
        i, first = 0, True
        pieces = []
        for m in _SENTENCE.finditer(padded):
            pieces.append((at, m.start()))
            at = m.end()
        pieces.append((at, len(padded)))
        for start, end in pieces:
            size = len(_COUNTED.findall(padded[start:end]))
            if not size:
                continue
            total += size
            while i < len(places) and places[i][0] < start:
                i += 1
            j, strong = i, None
            while j < len(places) and places[j][0] < end:
                if places[j][2] not in _SHORT_ONLY or size <= 60:
                    strong = strong or places[j][1]
                j += 1
            i = j
            if strong:
                covered += size
                kinds[strong] = kinds.get(strong, 0) + size
        share = covered / total if total else 0.0
        if share >= MESSAGE_SHARE:
            return max(kinds, key=lambda k: (kinds[k], k)), share
    if "filler" in hits and any(_is_filler(padded, places) for places in _by_sentence(padded, hits["filler"])):
        return "filler", max(share, sum(len(p) for _, p in hits["filler"]) / len(padded))
    if len(hits.get("latin", ())) >= 4 and _latin_run(folded):
        return "filler", max(share, min(1.0, 5 * len(hits["latin"]) / len(padded)))
    if (m := _REPEATED.search(text)) and not m.group(1).isdigit():
        return "filler", max(share, len(m.group(0)) / len(text))
    if "open" in hits and (found := placeholders(text)):
        return "placeholder", max(share, sum(map(len, found)) / len(text))
    return kind, share


def _mentioned(text: str, start: int, end: int) -> bool:
    """Whether one of the few words around a place, in its sentence, names a thing that holds placeholders rightly."""
    first = max(text.rfind("\n", 0, start), *(text.rfind(x, 0, start) for x in (". ", "! ", "? "))) + 1
    ends = [e for e in (text.find("\n", end), *(text.find(x, end) for x in (". ", "! ", "? "))) if e >= 0]
    before = _NEAR_WORD.findall(fold(text[max(first, start - 120) : start]))[-NEAR:]
    after = _NEAR_WORD.findall(fold(text[end : min(*ends, end + 120, len(text))]))[:NEAR]
    return any(ABOUT.fullmatch(w) for w in (*before, *after)) or ABOUT.search(" ".join(before[-2:])) is not None


def _bounds_of(text: str, at: int) -> tuple[int, int]:
    """Where the sentence or line around a place begins and ends."""
    ends = [e for e in (text.find("\n", at), text.find(". ", at)) if e >= 0]
    return max(text.rfind("\n", 0, at), text.rfind(". ", 0, at)) + 1, min(ends, default=len(text))


def _by_sentence(text: str, hits: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    groups: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for end, phrase in hits:
        groups.setdefault(_bounds_of(text, end), []).append((end, phrase))
    return list(groups.values())


def _is_filler(text: str, hits: list[tuple[int, str]]) -> bool:
    """Whether a sentence's filler phrases make up enough of it; a mention of such things is none."""
    a, b = _bounds_of(text, hits[0][0])
    covered = set()
    for end, phrase in hits:
        covered.update(range(end - len(phrase) + 1, end + 1))
    size = len(_COUNTED.findall(text[a:b]))
    return sum(1 for i in covered if text[i].isalnum()) >= FILLER_SHARE * size and not all(_mentioned(text, e - len(p) + 1, e + 1) for e, p in hits)


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, coverage) of every row, by its whole text; kind is null for real content and for null, empty and blank texts.

    Repeated rows are each judged; other columns aren't read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                kinds, shares = zip(*[judge(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], [key, "kind", "coverage"])

    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, kind string, coverage double")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to leave out, each once."""
    return judged(documents).where(F.col("kind").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def cleaned(documents: DataFrame) -> DataFrame:
    """The documents without those of ``found``; rows with a null doc_id stay."""
    return documents.join(found(documents), "doc_id", "left_anti")
