"""Text decoded with the wrong character encoding: detection and repair by a hidden Markov model.

The model has one clean state and one state for every pair of a true and a wrong encoding. In the clean state a
character has its probability after its predecessor under a model of intact text; in the state of a pair the same is
asked of the characters that the pair's inverse transform gives. Characters that are ASCII like their predecessor look
alike in all states, so the Viterbi pass visits only the others. Each labelled span gets its state's inverse transform,
and the pass is repeated for texts damaged more than once. Places where characters are lost for good (replacement
characters, question marks inside words) are labelled by a state without an inverse, a chain of its own.

Every text is labelled. A pair's state takes part in the pass over a text only if the best span of it pays for entering;
all others can't be on the best path. Sums of gains above zero, by a product of matrices, rule out most pairs before.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spread
from .glyphs import EMOJI_LIKE, INVISIBLE, plain_letter

#: Encodings that a text may have been written in, and those that it may have been read with.
WRITTEN = ("cp1252", "cp1250", "iso8859_2", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "cp1251", "koi8_u", "cp866", "iso8859_5", "mac_cyrillic")
READ = ("cp1252", "latin_1", "cp1250", "iso8859_2", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "cp1251", "koi8_u", "cp866", "iso8859_5", "mac_cyrillic", "cp1254", "cp1257")
#: Bigrams of a corpus for which the model's discounts are meant; a larger one's counts are taken in proportion.
CORPUS = 800_000
#: Log probability that a small letter is followed by a capital beyond ASCII.
INNER_CAPITAL = np.float32(-8.0)
#: Log odds of entering a pair's state and of leaving it.
ENTER, LEAVE = 8.0, 2.5
#: What a span must gain to be on the best path, less what single precision may miss.
PAYS = ENTER + LEAVE - 0.1
#: Log probability of a character that a pair can't have produced.
IMPOSSIBLE = -22.0
FLOOR = -15.0
LETTER_FLOOR = -8.0
#: Log odds that a valid UTF-8 sequence adds.
SEQUENCE = 3.0
ROUNDS = 3

# The letters beyond ASCII of the languages that texts are expected in.
ALPHABETS = "áčďéěíňóřšťúůýž äöüß àâçèéêëîïôœùûü áéíñóúü ąćęłńóśźż áäčďéíĺľňóôŕšťúýž абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
#: Words of one letter beyond ASCII; any other Latin letter alone between spaces is next to impossible.
ONE_LETTER, ALONE = "àéóÀÉÓ", -14.0
#: Written for this purpose: some text of each language, so that a small corpus has a model too.
SEED = """The quick review took three days, and nobody on the team was surprised by the result. It’s fine – we’re ready.
Příliš žluťoučký kůň úpěl ďábelské ódy. Včera jsme dokončili zprávu o řízení výroby a těšíme se na další úkoly, které nás čekají.
Schöne Grüße aus Köln: Die Straße war gesperrt, weil über Nacht größere Äste fielen. Können Sie das bitte prüfen?
Où êtes-vous allés cet été ? Le garçon a reçu une lettre très brève, et l’élève modèle préfère déjà la forêt à la plage. Ça coûte cœur.
El niño comió piñas mañana y después salió rápido. ¿Cuándo volverá? ¡Qué ilusión! La cigüeña vivía aquí según él.
Zażółć gęślą jaźń. Wczoraj zespół zakończył pracę nad źródłem błędów, więc możemy już świętować późniejszy sukces.
Kŕdeľ ďatľov učí koňa žrať kôru. Včera sme dokončili správu, ľudia sa tešia na ďalšie úlohy, ktoré nás čakajú vo štvrťroku.
Щастям б’ють жук їх глицю в фон й ґедзь пріє. Учора ми завершили звіт про керування, і команда чекає нових завдань є.
"""

_MARKS = re.compile(r"�|\?+")
_URL = re.compile(r"\S*(?:://|www\.|[=&]|\?\w+=)\S*")


def _bucket(ch: str) -> str:
    """The class of a character that the model has no column of its own for."""
    o = ord(ch)
    if 0x80 <= o < 0xA0:
        return "control"
    if 0x2500 <= o < 0x25A0:
        return "box"
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        name = unicodedata.name(ch, "")
        for script in ("LATIN", "CYRILLIC", "GREEK"):
            if name.startswith(script):
                return script + ("U" if kind == "Lu" else "L")
        return "letter"
    return "emoji" if o > 0x1F000 or kind == "So" else kind


_BUCKETS = ("control", "box", "LATINU", "LATINL", "CYRILLICU", "CYRILLICL", "GREEKU", "GREEKL", "letter", "emoji", "Mn", "Cf", "Zs", "Sc", "Sm", "Sk", "Po", "Ps", "Pe", "Pi", "Pf", "Pd", "Nd", "No", "Nl", "Co", "Cn", "Cc", "Cs", "Mc", "Me", "Lm", "Pc", "Zl", "Zp")


#: What stands for the characters beyond U+3000, which the model tells apart by no more than this.
OTHER_LETTER, OTHER_EMOJI = 0x3000, 0x1F000


@lru_cache(maxsize=1)
def _slots() -> tuple[np.ndarray, np.ndarray]:
    """Character -> its slot among those that the model may tell apart, and the slots' characters."""
    known = np.array(sorted([*Intact._classes(), OTHER_LETTER, OTHER_EMOJI]))
    stand = np.full(0x110000, OTHER_LETTER)
    stand[OTHER_EMOJI:] = OTHER_EMOJI
    stand[known] = known
    return np.searchsorted(known, stand).astype(np.int32), known


def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of the texts, each between line feeds, and how often each occurs. A bigram is a number made of the
    slots of its two characters, so there is a bounded number of them, however much text is counted."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot, known = _slots()
    codes = slot[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)]
    there = np.flatnonzero(np.bincount(codes, minlength=len(known)))
    if len(there) > 2000:
        return np.unique(codes[:-1].astype(np.int64) * len(known) + codes[1:], return_counts=True)
    place = np.zeros(len(known), np.int32)
    place[there] = np.arange(len(there))
    codes = place[codes]
    n = np.bincount(codes[:-1] * len(there) + codes[1:])
    i = np.flatnonzero(n)
    return there[i // len(there)] * len(known) + there[i % len(there)], n[i]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same bigrams added up; those that come to nothing are left out."""
    bigrams, same = np.unique(np.concatenate([np.zeros(0, np.int64), *[b for b, _ in parts]]), return_inverse=True)
    often = np.zeros(len(bigrams), np.int64)
    np.add.at(often, same, np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]]))
    return bigrams[often != 0], often[often != 0]


class Intact:
    """Character model of intact text: bigrams of lower-cased characters, times transitions of letter case.

    It is made of a corpus's bigrams and how often each occurs (``count``). All are counted; where there
    are more than ``CORPUS``, the counts are scaled down to it, so what is too rare to trust is the same part of a corpus of any size.
    """

    def __init__(self, bigrams: np.ndarray, often: np.ndarray, least: int = 8):
        slots = _slots()[1]
        before, here = slots[bigrams // len(slots)], slots[bigrams % len(slots)]
        often = often / max(1.0, often.sum() / CORPUS)
        lower = np.array([ord(chr(c).lower()[0]) for c in slots])
        known = np.bincount(lower[bigrams % len(slots)], often, minlength=1)
        seed = {ord(c) for c in (ALPHABETS + SEED).lower()}
        self.chars = sorted({int(c) for c in np.flatnonzero(known >= least) if c not in (OTHER_LETTER, OTHER_EMOJI)} | seed | set(range(10, 127)))
        self.index = np.zeros(0x110000, np.int16)
        first = len(self.chars)
        place = {b: first + i for i, b in enumerate(_BUCKETS)}
        self.size = first + len(_BUCKETS)
        self.case = np.zeros(0x110000, np.int8)
        own = {c: i for i, c in enumerate(self.chars)}
        memo = self._classes()
        self.index[:] = place["letter"]
        for c, (low, bucket, case) in memo.items():
            self.index[c] = own[low] if low in own else place[bucket]
            self.case[c] = case
        self.index[0x1F000:] = place["emoji"]
        self.case[0x3000:] = 0
        self._fit(before, here, often, np.frombuffer(("\n" + SEED).encode("utf-32-le"), np.uint32))

    @staticmethod
    @lru_cache(maxsize=1)
    def _classes() -> dict[int, tuple[int, str, int]]:
        out = {}
        for c in range(0x3000):
            ch = chr(c)
            low = ch.lower()
            bucket = _bucket(ch)
            out[c] = (ord(low) if len(low) == 1 else c, bucket if bucket in _BUCKETS else "Po", 2 if ch.isupper() else 1 if ch.isalpha() else 0)
        for c in (*range(0xE000, 0xE010), *range(0xF000, 0xF010), 0xFFFD):
            out[c] = (c, "Co", 0)
        return out

    def _possible(self) -> np.ndarray:
        """Which bigrams intact text may have: two characters beyond ASCII only from one alphabet, or with a quote, dash or
        the like; all else that a corpus holds of such pairs is taken for damage."""
        k = self.size
        beyond = np.array([c >= 128 for c in self.chars] + [True] * len(_BUCKETS))
        ok = ~(beyond[:, None] & beyond[None, :])
        quotes = self.index[[ord(c) for c in "–—…“”„‘’«»¿¡•−"] + [0xA0, 0x202F, 0x2009]]
        letters = np.unique(self.index[[ord(c) for c in ALPHABETS if ord(c) >= 128]])
        for own in ALPHABETS.split():
            i = np.unique(self.index[[ord(c) for c in own]])
            ok[np.ix_(i, i)] = True
        both = np.union1d(letters, quotes)
        ok[np.ix_(quotes, both)] = True
        ok[np.ix_(both, quotes)] = True
        free = [i for i in range(k) if i < len(self.chars) and self.chars[i] >= 0x2600 or i >= len(self.chars) and _BUCKETS[i - len(self.chars)] in ("emoji", "Cf", "Mn", "letter", "Zs")]
        ok[np.ix_(free, free)] = True
        return ok

    def _fit(self, before: np.ndarray, here: np.ndarray, often: np.ndarray, seed: np.ndarray) -> None:
        k = self.size
        counts = np.zeros((k, k))
        for a, b, n in ((before, here, often), (seed[:-1], seed[1:], np.full(len(seed) - 1, 0.5))):
            counts += np.bincount(self.index[a].astype(np.int64) * k + self.index[b], n, minlength=k * k).reshape(k, k)
        counts *= self._possible()
        counts = np.maximum(counts - 0.6, 0)  # an absolute discount: what stood there once may be damage
        uni = counts.sum(0) + 0.02
        for c in set(ALPHABETS.replace(" ", "")):
            uni[self.index[ord(c)]] += 2 + 2e-5 * often.sum()
        uni[len(self.chars) :] *= 0.2
        uni = uni / uni.sum()
        kinds = (counts > 0).sum(1)
        weight = 0.6 * kinds + 1.0
        p = (counts + weight[:, None] * uni[None, :]) / (counts.sum(1) + weight)[:, None]
        self.log = np.maximum(np.log(p), FLOOR).astype(np.float32)
        for own in ALPHABETS.split():  # an alphabet's letter beside its own or ASCII letters is never a great surprise
            i = np.unique(self.index[[ord(c) for c in own if ord(c) >= 128]])
            ascii_letters = self.index[[ord(c) for c in ("" if "б" in own else "abcdefghijklmnopqrstuvwxyz")] + [32, 10, 45]]
            for a, b in ((i, i), (i, ascii_letters), (ascii_letters, i)):
                self.log[np.ix_(a, b)] = np.maximum(self.log[np.ix_(a, b)], LETTER_FLOOR)
        # A dash, quote or ellipsis beside a space, digit or punctuation is never a great surprise either.
        marks = np.unique(self.index[[ord(c) for c in "–—…“”„‘’«»¿¡•−"]])
        beside = self.index[[32, 10, *range(33, 65), *range(91, 97)]]
        for a, b in ((marks, beside), (beside, marks)):
            self.log[np.ix_(a, b)] = np.maximum(self.log[np.ix_(a, b)], LETTER_FLOOR)
        # A sign before a letter, and Greek beside Latin, are implausible however often a corpus holds them.
        names = [unicodedata.category(chr(c)) if c >= 128 else "" for c in self.chars] + [b if len(b) == 2 else {"control": "So", "box": "So"}.get(b, "") for b in _BUCKETS]
        signs = np.array([n in ("Sm", "So", "Sk", "No", "Sc") and c not in (0xB0, 0x2212) for n, c in zip(names, [*self.chars, *[0] * len(_BUCKETS)])])
        latin = np.array([chr(c).isalpha() and (c < 0x250) for c in self.chars] + [b.startswith("LATIN") for b in _BUCKETS])
        greek = np.array([0x370 <= c < 0x400 for c in self.chars] + [b.startswith("GREEK") for b in _BUCKETS])
        for a, b in ((signs, latin), (greek, latin), (latin, greek)):
            self.log[np.ix_(a, b)] = np.minimum(self.log[np.ix_(a, b)], -13.0)
        cases = np.full((3, 3), 1.0)
        cases += np.bincount(self.case[before].astype(np.int64) * 3 + self.case[here], often, minlength=9).reshape(3, 3)
        cases = np.log(cases / cases.sum(1, keepdims=True))
        # Only what letter case adds: a letter's case after a letter.
        extra = np.zeros((3, 3), np.float32)
        extra[1, 2] = cases[1, 2] - np.log(0.5)
        extra[2, 1] = extra[2, 2] = 0.0
        self.extra = np.clip(extra, -5, 0)

    def score(self, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        case = self.case[codes]
        inner = (case == 2) & (codes >= 128) & (self.case[before] == 1)
        return np.maximum(self.log[self.index[before], self.index[codes]] + np.where(inner, INNER_CAPITAL, self.extra[self.case[before], case]), FLOOR).astype(np.float32)


#: What a single-byte pair may give beyond ASCII: letters of the alphabets, of either case, and common signs.
_SINGLE_OK = np.zeros(0x110000, bool)
for _c in set(ALPHABETS + ALPHABETS.upper() + "ãõÃÕøØåÅÆőűŐŰăâîșțĂÂÎȘȚčćđšžČĆĐŠŽêûôÊÛÔ§°²³«»¿¡ºª·–—’‘“”„…€№½×÷±©®ёыэъЁЫЭЪßẞ\xa0"):
    if len(_c) == 1:
        _SINGLE_OK[ord(_c)] = True
_SINGLE_OK[:128] = True


def _byte_table(encoding: str) -> np.ndarray:
    """Character -> byte of the encoding, -1 where it has none; undefined bytes are their C1 characters."""
    out = np.full(0x110000, -1, np.int16)
    for b in range(256):
        out[b if b < 128 else _char(encoding, b)] = b
    return out


def _char(encoding: str, b: int) -> int:
    try:
        return ord(codecs.decode(bytes([b]), encoding))
    except (UnicodeDecodeError, TypeError):
        return b


@lru_cache(maxsize=1)
def pairs() -> list[tuple[str, str, np.ndarray]]:
    """(true, wrong, table): for single-byte pairs the table gives the inverse of each character below U+3000 (-1: the
    pair can't have produced it), for UTF-8 read as a single-byte encoding the byte of each character."""
    out = []
    for wrong in READ:
        byte = _byte_table(wrong)[:0x3000]
        out.append(("utf_8", wrong, byte))
    for true in WRITTEN:
        back = np.array([b if b < 128 else _char(true, b) for b in range(256)] + [-1], np.int32)
        for b in range(128, 160):
            if back[b] == b:
                back[b] = -1
        for wrong in READ:
            if wrong == true:
                continue
            byte = _byte_table(wrong)[:0x3000].astype(np.int32)
            table = np.where(byte >= 0, back[byte], -1)
            table[~_SINGLE_OK[np.maximum(table, 0)]] = -1
            table[:128] = np.arange(128)
            out.append((true, wrong, table))
    return out


_UNSEEN = np.zeros(0x110000, bool)
_UNSEEN[[o for o in INVISIBLE if o >= 0x100]] = True
#: Characters that begin a UTF-8 sequence read as a Western or Central European encoding.
_LEADS = [ord(c) for c in "ÃÂÄÅĂĹĐŃÐÑ─┼├ƒ≈¬"]


@lru_cache(maxsize=1)
def plausible() -> np.ndarray:
    """Characters that a repair may give: letters of Latin, Greek and Cyrillic, their marks and signs, punctuation, emoji."""
    ok = np.zeros(0x110000, bool)
    for a, b in ((0x20, 0x7F), (0xA0, 0x180), (0x218, 0x21C), (0x2C6, 0x2DE), (0x300, 0x330), (0x370, 0x3CF), (0x400, 0x460), (0x490, 0x492), (0x1E80, 0x1E86), (0x1E9E, 0x1E9F), (0x2000, 0x2050), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2190, 0x2300), (0x2600, 0x27C0), (0xFB00, 0xFB03), (0xFE0F, 0xFE10), (0xFEFF, 0xFF00), (0x1F000, 0x1FB00)):
        ok[a:b] = True
    ok[9:11] = ok[13] = True
    return ok


def _before(codes: np.ndarray) -> np.ndarray:
    """At each position that of the last character before it that can be seen."""
    at = np.where(_UNSEEN[codes], 0, np.arange(len(codes)))
    return np.concatenate(([0], np.maximum.accumulate(at)[:-1]))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, each after a line feed, and where each text starts."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    starts = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return codes, starts


class Repairer:
    """Labels and repairs batches of texts under a model of intact text."""

    def __init__(self, model: Intact):
        self.model = model
        #: The single-byte pairs' places in ``pairs`` and their tables.
        self._single_pairs = [k for k, (true, _, _) in enumerate(pairs()) if true != "utf_8"]
        self._single = np.stack([pairs()[k][2] for k in self._single_pairs])

    def __getstate__(self):
        return {"model": self.model}

    def __setstate__(self, state):
        self.__init__(state["model"])

    def _plain(self, texts: list[str], codes: np.ndarray) -> np.ndarray:
        """The characters as the clean state sees them: stand-ins for ASCII letters beside ASCII letters count as those."""
        out = codes.copy()
        odd = np.flatnonzero(plain_letter()[codes] != codes)
        if len(odd):
            mapped = plain_letter()[codes]
            seen = np.where(codes >= 0x2000, mapped, codes)
            ascii_letter = (seen < 0x250) & (self.model.case[np.minimum(seen, 0x24F)] > 0)
            # A stand-in of another script counts as such only in a word that also has ASCII letters; compatibility forms always do.
            word = (self.model.case[codes] > 0) | (mapped != codes)
            number = np.cumsum(np.diff(np.concatenate(([0], word.astype(np.int8)))) != 0)
            beside = word & (np.bincount(number, ascii_letter, minlength=number[-1] + 1)[number] > 0)
            use = odd[beside[odd] | (codes[odd] >= 0x2000)]
            use = use[(codes[use] != 0xA0) | ~np.isin(codes[use - 1], _LEADS)]
            out[use] = mapped[use]
        return out

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the damaged spans: (start, end, index in ``pairs``)."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t, places, kept in self._paying(texts):
            for i, j, s in _viterbi(np.stack([g for _, g in kept])):
                out[t].append((int(places[i]), int(places[j - 1]) + 1, kept[s][0]))
        return out

    def damaged(self, texts: list[str]) -> list[bool]:
        """Which texts ``repair`` finds damaged: those with a span that pays, or with a mark for a lost character."""
        out = [bool(self._lost_at(t)) for t in texts]
        rest = [i for i, bad in enumerate(out) if not bad]
        for t, _, kept in self._paying([texts[i] for i in rest]):
            out[rest[t]] = any(_best_span(g[None].astype(float))[0] > ENTER + LEAVE for _, g in kept)
        return out

    def _paying(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]]:
        """(text, its places, [(pair, gains)]) of the texts with pairs that may pay: no span of the best path gains less
        than entering and leaving its state cost, since without it the path would be better."""
        codes, starts = _codes(texts)
        plain = self._plain(texts, codes)
        prev = _before(codes)
        at = np.flatnonzero(((codes >= 128) | (codes[prev] >= 128)) & ~_UNSEEN[codes])
        at = at[at > 0]
        if not len(at):
            return
        clean = self.model.score(plain[prev[at]], plain[at])
        here, before = codes[at], codes[prev[at]]
        neutral = (here >= 0x3000) | EMOJI_LIKE[np.minimum(here, 0x2FFF)] | ((plain[at] != here) & (here >= 0x2000))
        of = np.searchsorted(starts, at, side="right") - 1
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        some = np.flatnonzero(np.diff(bounds))
        soft = np.flatnonzero((here == 0xAD) & (self.model.case[before] > 0) & ~np.isin(before, _LEADS))
        clean[soft] = 0.0
        after = soft[soft + 1 < len(at)] + 1
        clean[after[at[after] == at[after - 1] + 1]] = -1.0
        alone = (here >= 0xC0) & (here < 0x250) & np.isin(codes[at - 1], (10, 32)) & np.isin(codes[np.minimum(at + 1, len(codes) - 1)], (10, 32)) & ~np.isin(here, [ord(c) for c in ONE_LETTER])
        clean[alone] = np.minimum(clean[alone], ALONE)
        bigrams, same = np.unique((before << 21) | here, return_inverse=True)
        up, e = self._bounds(bigrams, same, clean, neutral, of, len(texts))
        utf8 = self._utf8_gains(codes, at, prev, clean, neutral, bounds)
        for t in some:
            a, b = bounds[t], bounds[t + 1]
            rows = np.flatnonzero(up[t] > PAYS)
            gains = _gain(e[rows[:, None], same[a:b]] - clean[a:b], neutral[a:b])
            strong = _best_span(gains) > PAYS if len(rows) else np.zeros(0, bool)
            kept = [(self._single_pairs[k], g) for k, g in zip(rows[strong], gains[strong])]
            kept += [(k, g[a:b]) for k, g, has in utf8 if has[t] and _best_span(g[None, a:b])[0] > PAYS]
            if kept:
                yield t, at[a:b] - starts[t], sorted(kept, key=lambda x: x[0])

    def _bounds(self, bigrams: np.ndarray, same: np.ndarray, clean: np.ndarray, neutral: np.ndarray, of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For every text and single-byte pair an upper bound of what the pair's state can gain in it: the sum of all gains
        above zero, each taken where the clean state does worst; and the emissions of every pair for every bigram."""
        here, before = bigrams & 0x1FFFFF, bigrams >> 21
        low, low_before = np.minimum(here, 0x2FFF), np.minimum(before, 0x2FFF)
        now = np.where(here < 0x3000, self._single[:, low], -1)
        prev = np.where(before < 0x3000, self._single[:, low_before], -1)
        e = np.where(now < 0, IMPOSSIBLE, self.model.score(np.where(prev < 0, before, prev), np.where(now < 0, 0, now))).astype(np.float32)
        worst = np.full(len(bigrams), np.inf)
        np.minimum.at(worst, same[~neutral], clean[~neutral])
        gain = np.maximum(e - worst, 0).astype(np.float32)
        counts = np.bincount(of * len(bigrams) + same, ~neutral, minlength=n_texts * len(bigrams)).astype(np.float32).reshape(n_texts, -1)
        return counts @ gain.T, e

    def _utf8_gains(self, codes: np.ndarray, at: np.ndarray, prev: np.ndarray, clean: np.ndarray, neutral: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(pair, its gains, which texts have a sequence of it) of every pair by which UTF-8 was misread; without a valid
        sequence its state gains nothing."""
        out = []
        for k, (true, _, table) in enumerate(pairs()):
            if true == "utf_8":
                value, length = self._sequences(table, codes, at)
                if length.any():
                    has = np.diff(np.concatenate(([0], np.cumsum(length > 0)))[bounds]) > 0
                    mine = np.flatnonzero(np.repeat(has, np.diff(bounds)))
                    gains = np.zeros(len(at))
                    gains[mine] = self._utf8(value[mine], length[mine], codes, at[mine], prev) - clean[mine]
                    gains[neutral] = 0.0
                    out.append((k, gains, has))
        return out

    def _utf8(self, value: np.ndarray, length: np.ndarray, codes: np.ndarray, at: np.ndarray, prev: np.ndarray) -> np.ndarray:
        whole = np.array(codes)
        inside = np.zeros(len(codes), bool)
        for n in (2, 3, 4):
            s = at[length == n]
            for j in range(n):
                whole[s + j] = value[length == n]
                if j:
                    inside[s + j] = True
        e = self.model.score(whole[prev[at]], whole[at])
        e[length > 0] += SEQUENCE  # bytes seldom form a valid sequence by chance
        e[inside[at]] = 0.0
        lone = (codes[at] >= 128) & (length == 0) & ~inside[at]
        e[lone] = IMPOSSIBLE
        return e

    @staticmethod
    def _sequences(table: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each position the character that a UTF-8 sequence starting there encodes, and the sequence's length (0: none)."""
        whole_value, whole_length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        first = codes[at]
        lead = np.flatnonzero((first < 0x3000) & (first >= 0x80))
        lead = lead[table[first[lead]] >= 0xC2]
        if not len(lead):
            return whole_value, whole_length
        padded, at = np.concatenate((codes, [0, 0, 0])), at[lead]
        byte = [np.where(padded[at + j] < 0x3000, table[np.minimum(padded[at + j], 0x2FFF)], -1).astype(np.int64) for j in range(4)]
        cont = [(b >= 0x80) & (b < 0xC0) for b in byte]
        two = (byte[0] >= 0xC2) & (byte[0] < 0xE0) & cont[1]
        three = (byte[0] >= 0xE0) & (byte[0] < 0xF0) & cont[1] & cont[2]
        four = (byte[0] >= 0xF0) & (byte[0] < 0xF5) & cont[1] & cont[2] & cont[3]
        value = np.select(
            [two, three, four],
            [
                ((byte[0] & 0x1F) << 6) | (byte[1] & 0x3F),
                ((byte[0] & 0x0F) << 12) | ((byte[1] & 0x3F) << 6) | (byte[2] & 0x3F),
                ((byte[0] & 0x07) << 18) | ((byte[1] & 0x3F) << 12) | ((byte[2] & 0x3F) << 6) | (byte[3] & 0x3F),
            ],
            0,
        )
        length = np.select([two, three, four], [2, 3, 4], 0)
        bad = ~plausible()[np.minimum(value, 0x10FFFF)] | (three & (value < 0x800)) | (four & ((value < 0x10000) | (value > 0x10FFFF))) | ((value >= 0xD800) & (value < 0xE000))
        whole_value[lead], whole_length[lead] = np.where(bad, 0, value), np.where(bad, 0, length)
        return whole_value, whole_length

    def repair(self, texts: list[str]) -> list[tuple[str, bool, bool]]:
        """(restored text, damaged, something is lost) of each text."""
        out = [(t, False, False) for t in texts]
        now = dict(enumerate(texts))
        hit: set[int] = set()
        todo = list(now)
        for _ in range(ROUNDS):
            spans = self.label([now[i] for i in todo]) if todo else []
            again = []
            for i, s in zip(todo, spans):
                if s:
                    hit.add(i)
                    fixed = invert(now[i], s)
                    if fixed != now[i]:
                        now[i] = fixed
                        again.append(i)
            todo = again
        for i, t in enumerate(texts):
            lost = bool(self.lost(t)) or "�" in now[i]
            out[i] = (now[i], i in hit or lost, lost)
        return out

    def lost(self, text: str) -> list[tuple[int, int]]:
        """The spans of the state without an inverse: places that hold a mark for a character lost for good.

        The mark U+FFFD stands in no intact text, a question mark not inside a word (but in addresses), so in the clean
        state both cost at least what entering and leaving the state does. The state is a chain of its own, since a
        character can be lost inside a span of any pair.
        """
        at = self._lost_at(text)
        if not at:
            return []
        codes, starts = _codes([text])
        i = np.array(at) + starts[0]
        gain = np.maximum(-self.model.score(codes[i - 1], codes[i]), ENTER + LEAVE + 1)
        spaced = np.full((1, 2 * len(at)), IMPOSSIBLE)  # what lies between two marks is the clean state's
        spaced[0, ::2] = gain
        return [(at[a // 2], at[a // 2] + 1) for a, _, _ in _viterbi(spaced)]

    @staticmethod
    def _lost_at(text: str) -> list[int]:
        if "�" not in text and "?" not in text:
            return []
        return [m.start() for m in _MARKS.finditer(text) if m.group(0) == "�" or _inside_word(text, m.start(), m.end())]


def _inside_word(text: str, start: int, end: int) -> bool:
    """Whether question marks stand between a letter and a small one, or one between a letter and two; not in an address."""
    before, after = text[start - 1 : start], text[end : end + 2]
    if not before.isalpha() or not after[:1].isalpha():
        return False
    if "A" <= after[0] <= "Z" and (end - start > 1 or not after[1:].isalpha()):
        return False
    return not _URL.search(text[text.rfind(" ", 0, start) + 1 : end + 30].split()[0])


def _gain(d: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """Gains over the clean state by pair (row) and place; at neutral places none."""
    d[:, neutral] = 0.0
    return d


def _best_span(gains: np.ndarray) -> np.ndarray:
    """The largest sum of any span of each row: no path labels a row whose best span doesn't pay for entering."""
    if not gains.shape[1]:
        return np.zeros(len(gains))
    sums = np.cumsum(gains, axis=1)
    least = np.minimum.accumulate(np.concatenate((np.zeros((len(gains), 1)), sums[:, :-1]), axis=1), axis=1)
    return (sums - least).max(1)


def _viterbi(gain: np.ndarray) -> list[tuple[int, int, int]]:
    """Best path over states clean (gain 0) and one per row: the spans (start, end, row)."""
    n_states, n = gain.shape
    best_clean, best = 0.0, np.full(n_states, -np.inf)
    from_clean = np.zeros((n, n_states), bool)
    left = np.full(n, -1)
    for t in range(n):
        top = int(best.argmax())
        if best[top] - LEAVE > best_clean:
            best_clean, left[t] = best[top] - LEAVE, top
        enter = best_clean - ENTER
        from_clean[t] = enter >= best
        best = np.maximum(best, enter) + gain[:, t]
    spans = []
    top = int(best.argmax())
    state = top if best[top] - LEAVE > best_clean else -1
    end = n
    for t in range(n - 1, -1, -1):
        if state < 0:
            state, end = int(left[t]), t
        elif from_clean[t, state]:
            spans.append((t, end, state))
            state, end = int(left[t]), t
    return spans[::-1]


def invert(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's inverse transform applied; characters that the pair can't have produced stay."""
    out, at = [], 0
    for start, end, k in spans:
        true, _, table = pairs()[k]
        if start < at:
            start = at
        out.append(text[at:start])
        if true == "utf_8":
            while end < len(text) and ord(text[end]) >= 128 and 0x80 <= (table[min(ord(text[end]), 0x2FFF)] if ord(text[end]) < 0x3000 else -1) < 0xC0:
                end += 1
            out.append(_from_utf8(text[start:end], table))
        else:
            out.append("".join([chr(table[ord(c)]) if ord(c) < 0x3000 and table[ord(c)] >= 0 else c for c in text[start:end]]))
        at = end
    out.append(text[at:])
    return "".join(out)


def _from_utf8(piece: str, table: np.ndarray) -> str:
    codes = np.array([ord(c) for c in piece], np.int64)
    if not len(codes):
        return piece
    value, length = Repairer._sequences(table, codes, np.arange(len(codes)))
    out, i = [], 0
    while i < len(piece):
        if length[i]:
            out.append(chr(int(value[i])))
            i += int(length[i])
        else:
            out.append(piece[i])
            i += 1
    return "".join(out)


def fit(texts: list[str]) -> Repairer:
    """Model of intact text from a list: fitted, then fitted again without the texts that it finds damaged."""
    bad = Repairer(Intact(*count(texts))).damaged(texts)
    return Repairer(Intact(*count([t for t, b in zip(texts, bad) if not b])))


def counted(texts: DataFrame, damaged_by: Repairer | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``count`` of a whole column of texts, or of those in it that a model finds damaged; every worker adds up its own."""
    spark: SparkSession = texts.sparkSession
    model = spark.sparkContext.broadcast(damaged_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                given = [t for t in whole.column(0).slice(at, 1000).to_pylist() if t]
                if model.value is not None:
                    given = [t for t in given if not t.isascii() or "?" in t]
                    given = [t for t, bad in zip(given, model.value.damaged(given)) if bad]
                sums.append(count(given))
                if len(sums) == 50:
                    sums = [added(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in added(sums)], ["bigram", "often"])

    # No more rows than bigrams, whose number the characters bound and not the texts.
    got = texts.mapInArrow(run, "bigram bigint, often bigint").groupBy("bigram").agg(F.sum("often").alias("often")).toArrow()
    return added([(got.column(0).to_numpy(), got.column(1).to_numpy())])


def repaired(texts: DataFrame, repairer: Repairer, keys: list[str], text: str) -> DataFrame:
    """(keys, restored, damaged, lost) of every row: the text as it was written as far as it survives, whether it was
    damaged anywhere, and whether something of it is lost.

    Null and empty texts come back as they are and aren't damaged; repeated rows are each repaired; whole texts are
    looked at; an empty table gives an empty one. Other columns aren't read.
    """
    spark: SparkSession = texts.sparkSession
    model = spark.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                given = b.column(len(keys)).to_pylist()
                some = [i for i, t in enumerate(given) if t and not t.isascii() or t and "?" in t]
                got = dict(zip(some, r.repair([given[i] for i in some])))
                rows = [got.get(i, (t, False, False)) for i, t in enumerate(given)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.bool_()), pa.array([x[2] for x in rows], pa.bool_())], [*keys, "restored", "damaged", "lost"])

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return spread(texts.select(*keys, text)).mapInArrow(run, f"{kinds}, restored string, damaged boolean, lost boolean")


def repairer_for(*sources: tuple[DataFrame, str, str]) -> Repairer:
    """Fits the model on all texts of each (table, key, text column), as ``fit`` does: once on all, then without those
    that it finds damaged, whose counts are taken off."""
    texts = reduce(DataFrame.unionByName, [df.select(F.col(text).alias("text")) for df, _, text in sources])
    whole = counted(texts)
    bigrams, often = counted(spread(texts), Repairer(Intact(*whole)))
    return Repairer(Intact(*added([whole, (bigrams, -often)])))


def _damaged(scans: DataFrame, flags: DataFrame, repairer: Repairer | None) -> DataFrame:
    """(src, rec_id, restored, lost) of the damaged rows of both tables under one model, fitted on both where none is given."""
    r = repairer or repairer_for((scans, "scan_id", "visible_text"), (flags, "flag_id", "evidence"))
    parts = [
        repaired(df, r, [key], text).where("damaged").select(F.lit(src).alias("src"), F.col(key).cast("long").alias("rec_id"), "restored", "lost")
        for src, df, key, text in (("scan", scans, "scan_id", "visible_text"), ("flag", flags, "flag_id", "evidence"))
    ]
    return parts[0].unionByName(parts[1])


def found(scans: DataFrame, flags: DataFrame, repairer: Repairer | None = None) -> DataFrame:
    """(src, rec_id) of every scan and flag with damaged text, each once however often its row came; null ids have no row."""
    return _damaged(scans, flags, repairer).where(F.col("rec_id").isNotNull()).select("src", "rec_id").distinct()


def restored(scans: DataFrame, flags: DataFrame, repairer: Repairer | None = None) -> DataFrame:
    """(src, rec_id, restored, lost): the damaged texts of both tables as they were written, as far as they survive, and
    whether something of them is lost. Equal rows count once; damaged texts without an id are given back too."""
    return _damaged(scans, flags, repairer).distinct()
