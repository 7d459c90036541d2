"""Problem 6: personal information inside free text, by offset-preserving deobfuscation.

A text is normalised for detection by transducers (full-width and look-alike
letters, invisible characters, spelled-out digits, at/dot disguises), each of
which keeps for every normalised character the source span it came from.
Identifiers are detected in the normalised text and mapped back, so finds are
exact substrings of the source and replacement leaves all else as it is.

Names are found by given names that are known and by surnames whose endings
the corpus itself teaches: one pass over all texts counts, for the words next
to known given names, their endings with the number of different given names,
and how often each word occurs elsewhere. What is learned is decided by shares
of these counts, alike at every size, so the model is bounded: endings and
whole surnames of up to ENDING letters by RARE_NAME, ordinary words (64-bit
hashes of them) by RARE_WORD. More than MAX_GIVEN given names are refused.

Defined results: null, empty and blank texts have no finds and stay as they
are; a text found twice in one content is one row; an empty table gives an
empty result; redaction marks already in a text are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import Scratch

ENDING, MIN_GIVEN = 4, 3
#: A word that is fewer than one in RARE_WORD of all counts, or an ending or short surname that is fewer than one in RARE_NAME, isn't learned; so the model has at most so many of each, whatever the input.
RARE_WORD, RARE_NAME = 4_000_000, 100_000
MAX_GIVEN = 1_000_000

# --- fixed values: look-alikes, spelled digits, street words, labels -------
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsdgABEZHIKMNOPTYXo"))
INVISIBLE = set("​‌‍⁠﻿­")
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "sıfır": "0", "bir": "1", "iki": "2", "üç": "3", "dört": "4", "beş": "5", "altı": "6", "yedi": "7", "sekiz": "8", "dokuz": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "plus": "+",
}
STREET_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Close|Mews|Terrace|Ter|Place|Pl|Way|Square|Sq|Crescent|Cres|Boulevard|Blvd|Grove|Gardens|Hill|Row|Walk|Parade|Circle|Highway|Hwy"
STREET_TR = r"Sokak|Sokağı|Sk\.?|Sok\.?|Caddesi|Cadde|Cad\.?|Cd\.?|Bulvarı|Blv\.?|Bulv\.?|Mahallesi|Mah\.?|Meydanı|Yolu"
STREET_DE = r"straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm|steig|stieg|graben|markt|pfad|chaussee|wall|promenade|zeile|(?<=[b-df-hj-np-tv-z])ring"
ID_LABEL = (
    r"ssn|ss\s?\#|soc(?:ial|\.)?\s?sec(?:urity|\.)?|tckn|t\.?\s?c\.?\s?kimlik|kimlik|tc\s?no|national\s+id(?:entity|entification)?|nat(?:ional|\.)?\s?ins(?:urance|\.)?|nino|ni\s?(?=no|num|\#|:)"
    r"|passport|pasaport|reisepass|personalausweis|ausweis|sozialversicherung|steuer-?id|identity\s+(?:card\s+)?(?=no|num)|id\s+card"
)
TITLES = {"dr", "prof", "mr", "ms", "mrs", "herr", "frau", "bay", "bayan", "sayın", "sn"}

_LOCAL = r"(?<![\w.+%-])[\w][\w.+%-]*"
_LABEL = r"[^\W_][\w-]*"
EMAIL = re.compile(rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}(?![\w-])", re.I)
#: Disguises of the at and of dots: in brackets, coded, set apart; and spelled out in a whole address.
_BRACKETED = re.compile(r"(?P<at>\s@\s|\s?[(\[{<]\s?(?:at|a|@|et)\s?[)\]}>]\s?|&\#64;|%40)|(?P<dot>\s?[(\[{<]\s?(?:dot|punkt|nokta|\.)\s?[)\]}>]\s?)", re.I)
_SPOKEN = re.compile(rf"{_LOCAL}\s+(?:at|et)\s+{_LABEL}(?:(?:\s+(?:dot|punkt|nokta)\s+|\.){_LABEL})*\s+(?:dot|punkt|nokta)\s+[^\W\d_]{{2,}}(?![\w-])", re.I)
_SPOKEN_SIGN = re.compile(r"\s+(?:(?P<at>at|et)|(?P<dot>dot|punkt|nokta))\s+", re.I)
_EMAIL_HINT = re.compile(r"@|%40|&#64;|[(\[{<]\s?(?:at|a|et)\s?[)\]}>]|\b(?:at|et)\s+[\w-]+(?:\s|\.).*?\b(?:dot|punkt|nokta)\b", re.I)
_SHORT_ID = r"(?:[A-Z]{2}[ \-]?\d\d[ \-]?\d\d[ \-]?\d\d[ \-]?[A-D]|[A-Z]{0,2}\d(?:[ .\-]?\d){5,12})(?!\w)"
ID_NUMBER = re.compile(
    rf"(?<![\w])(?:{ID_LABEL})(?:[\s\-]?(?:no|nr|num|number|numarası|nummer|card|id|code)\b)?(?:\s+(?:is|ist|was|lautet))?[\s.:#=\-–(\"'’]{{0,4}}(?P<v>{_SHORT_ID})"
    rf"|(?<![\w.+/-])(?P<w>{_SHORT_ID})\s?[(\[]\s?(?:{ID_LABEL})",
    re.I,
)
PHONE = re.compile(r"(?<![\w.+/@#-])(?<!\d[ ,:])(?:\+|(?=[\d(]))(?:\(?\d[\d]*\)?)(?:[ \-./]{0,2}\(?\d+\)?){0,7}(?!\w)")
_PHONE_HINT = re.compile(r"(?:\d[ \-./()]{0,3}){9}")
PHONE_WORD = re.compile(r"(?:call|phone|tel|telefon|mobile|cell|whatsapp|sms|ring|fax|numara|rückruf|ara|contact|dial|handy|mobil)\W*(?:\w+\W+){0,2}$", re.I)
ADDRESS_EN = re.compile(
    rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?(?:\s?[-–]\s?\d{{1,5}}[A-Za-z]?)?,?\s(?:[A-ZÇĞİÖŞÜÄ][\w’'-]+\s){{1,3}}(?:(?:{STREET_EN})\b\.?|(?:{STREET_EN.upper()})\b\.?)"
)
ADDRESS_TR = re.compile(
    rf"\b(?:[A-ZÇĞİÖŞÜ0-9][\w.’'-]*\s){{1,3}}(?:{STREET_TR}|(?:{STREET_TR.upper()}))\s?,?\s?(?:[Nn][Oo]\.?\s?:?\s?)?\d{{1,5}}(?:\s?[/-]\s?\d{{1,4}})?[A-Za-z]?(?!\w)"
)
ADDRESS_DE = re.compile(
    rf"\b(?:[A-ZÄÖÜ][\wäöüß-]{{2,}}(?:{STREET_DE})|[A-ZÄÖÜ][A-ZÄÖÜ-]{{2,}}(?:STRASSE|STR\.|WEG|PLATZ|ALLEE|GASSE|UFER|DAMM|PFAD|RING)|(?:[A-ZÄÖÜ][\wäöüß]+[er]\s)(?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Ufer|Damm|Ring))\s\d{{1,4}}[a-zA-Z]?(?:\s?[-–/]\s?\d{{1,4}}[a-z]?)?(?!\w)"
)
_WORD = r"[^\W\d_]+(?:['’][^\W\d_]{2,})?(?:-[^\W\d_]+)*"
_WORDS = re.compile(_WORD)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words that stand free, not inside addresses, paths and identifiers.
_FREE = re.compile(r"(?<![\w@./+-])[^\W\d_]+(?![\w@/]|[.+-]\w)")


_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {0xFF01 + k: chr(0x21 + k) for k in range(94)} | {0xA0: " ", 0x202F: " ", 0x2007: " ", 0x3000: " "} | {ord(c): "-" for c in "‐‑‒–—−"}


def transduce(text: str, words: list[str]) -> tuple[str, list[int] | None]:
    """(normalised text, source position of each of its characters and of its end), the latter None where they are the same."""
    at = None
    if not text.isascii():
        if not INVISIBLE.isdisjoint(text):
            at = [i for i, ch in enumerate(text) if ch not in INVISIBLE] + [len(text)]
            text = "".join(ch for ch in text if ch not in INVISIBLE)
        text = text.translate(_FOLD)
    if sum(w in SPELLED for w in words) < 7 or not _SPELLED_RUN.search(text):
        return text, at
    out, where, last = [], [], 0
    at = at or list(range(len(text) + 1))
    for run in _SPELLED_RUN.finditer(text):
        out.append(text[last : run.start()])
        where += at[last : run.start()]
        for w in _SPELLED_WORD.finditer(run.group()):
            out.append(SPELLED[w.group().lower()])
            where.append(at[run.start() + w.start()])
        last = run.end()
        # the end of the last digit's word is kept through a mark that no pattern takes in
        out.append("\x00")
        where.append(at[run.end()])
    out.append(text[last:])
    where += at[last:]
    return "".join(out), where


def undisguise(text: str) -> tuple[str, list[int]]:
    """(text with disguised ats and dots as signs, position in ``text`` of each of its characters and of its end)."""
    signs = [(m.start(), m.end(), "@" if m.group("at") else ".") for m in _BRACKETED.finditer(text)]
    taken = {x for s, e, _ in signs for x in range(s, e)}
    for m in _SPOKEN.finditer(text):
        if taken.isdisjoint(range(*m.span())):
            signs += [(n.start(), n.end(), "@" if n.group("at") else ".") for n in _SPOKEN_SIGN.finditer(text, *m.span())]
    out, where, last = [], [], 0
    for s, e, sign in sorted(signs):
        out += [text[last:s], sign]
        where += [*range(last, s), s]
        last = e
    return "".join(out) + text[last:], where + list(range(last, len(text) + 1))


_SPELLED_WORD = re.compile(r"\b(?:" + "|".join(SPELLED) + r")\b", re.I)
_SPELLED_RUN = re.compile(r"\b(?:" + "|".join(SPELLED) + r")(?:[ \-,]{1,2}(?:" + "|".join(SPELLED) + r")\b){6,}", re.I)


_NO_PHONE = re.compile(r"(?:version|offset|code|port|build|order|trace|line|iso)\W{0,2}$", re.I)


def valid_phone(s: str, before: str) -> bool:
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    if _NO_PHONE.search(before):
        return False
    groups = re.findall(r"\d+", s)
    if s.startswith("+"):
        return 9 <= n <= 15
    if s.startswith("00"):
        return 11 <= n <= 16
    if re.fullmatch(r"(?:1[ \-./]?)?\(?\d{3}\)?[ \-./]{0,2}\d{3}[ \-./]\d{4}", s):
        return len({c for c in s if c in "-./"}) <= 1 or "(" in s
    if len(groups) >= 4 and 11 <= n <= 13 and digits[0] != "0":
        return len({c for c in s if c in "-./"}) <= 1
    if digits[0] == "0" or s.startswith("(0"):
        return 9 <= n <= 12 and (len(groups) > 1 or n in (10, 11) and bool(PHONE_WORD.search(before)))
    return 9 <= n <= 12 and (len(groups) == 1 or "(" in s) and n in (10, 11) and bool(PHONE_WORD.search(before))


class Hashed:
    """A set of words by their 64-bit hashes, as the JVM makes them."""

    def __init__(self, hashes):
        self.hashes = np.sort(np.asarray(hashes, np.int64))

    def __contains__(self, word: str) -> bool:
        h = np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)).astype(np.int64)
        at = np.searchsorted(self.hashes, h)
        return at < len(self.hashes) and self.hashes[at] == h


class Names:
    """Finds names by known given names, learned surname endings and ordinary words."""

    def __init__(self, given: set[str], endings: set[str], ordinary: set[str], before: set[str], short: set[str] = frozenset()):
        self.given, self.endings, self.ordinary, self.before, self.short = given, endings, ordinary, before, short

    def surname(self, w: str) -> bool:
        parts = w.split("-")
        return all((p in self.short or len(p) >= ENDING + 1 and p[-ENDING:] in self.endings) and p not in self.ordinary and p not in self.given for p in map(lower, parts))

    def find(self, text: str):
        words = [(m.start(), m.end(), m.group()) for m in _WORDS.finditer(text)]
        for k, (start, end, w) in enumerate(words):
            if not self.surname(w):
                continue
            if start and text[start - 1] in "_.@/+\\" or end < len(text) and (text[end] in "_@/\\" or text[end] == "." and text[end + 1 : end + 2].isalnum()):
                continue
            # given name or initials before it
            j, gap = k - 1, text[words[k - 1][1] : start] if k else ""
            first = None
            while j >= 0 and k - j <= 3:
                gs, ge, g = words[j]
                between = text[ge : words[j + 1][0]]
                initial = len(g) == 1 and re.fullmatch(r"\.?\s{0,2}|\.[\s ]{1,2}", between)
                if gs and text[gs - 1] in "_.@/+\\" and not initial:
                    break
                if initial and g.isupper() == w[0].isupper() and (g.isupper() or "." in between) and (gs == 0 or text[gs - 1] not in "'’.") and "\n" not in between:
                    first = gs
                    j -= 1
                    continue
                if re.fullmatch(r"[ \t ]{1,2}|\n", between) and self.given_like(g, w):
                    first = gs
                break
            if first is not None:
                yield first, end
                continue
            # surname, given name or initial
            if k + 1 < len(words):
                gs, ge, g = words[k + 1]
                if re.fullmatch(r",\s{1,2}", text[end:gs]):
                    tail = ge
                    if len(g) == 1 and text[ge : ge + 1] == ".":
                        yield start, ge + 1
                    elif self.given_like(g, w, strict=True) and not (text[ge : ge + 1] in ("_", "@", "/") or text[ge : ge + 1] == "." and text[ge + 1 : ge + 2].isalnum()):
                        m = re.match(r"\s[A-ZÇĞİÖŞÜ]\.", text[ge:])
                        yield start, tail + (m.end() if m else 0)
                elif re.fullmatch(r"\s{1,2}", text[end:gs]) and lower(g) in self.given and g[0].isupper() == w[0].isupper() and (k == 0 or not self.given_like(words[k - 1][2], w)):
                    if not (text[ge : ge + 1] in ("_", "@", "/") or text[ge : ge + 1] == "." and text[ge + 1 : ge + 2].isalnum()):
                        yield start, ge

    def given_like(self, g: str, surname: str, strict: bool = False) -> bool:
        low = lower(g)
        if low in TITLES:
            return False
        if all(p in self.given for p in low.split("-")):
            return True
        if len(g) < 3 or low in self.ordinary or low in self.before or self.surname(g):
            return False
        return g[0].isupper() == surname[0].isupper() and (g[0].isupper() or not strict) and (g[1:].isupper() == surname[1:].isupper())


def lower(w: str) -> str:
    return w.lower().replace("i̇", "i") if w.isascii() or "İ" not in w else w.replace("İ", "i").lower()


_STREET_WORDS = frozenset(w.lower() for w in STREET_EN.split("|"))
#: Each word of the pattern as lower() makes it of either case, alone and with the "No" that may follow without a space.
_STREET_TR = frozenset(lower(c) + no for w in STREET_TR.replace(r"\.?", "").split("|") for c in (w, w.upper()) for no in ("", "no"))
_STREET_DE = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ufer", "damm", "steig", "stieg", "graben", "markt", "pfad", "chaussee", "wall", "promenade", "zeile", "ring")
#: What the first or last run of letters of any match of ID_LABEL is, or begins with.
_ID_WORDS = frozenset("ss soc social tc nat national ni identity id steuer".split())
_ID_BEGIN = tuple("ssn socsec socialsec tckn tckimlik ckimlik kimlik tcno natins nationalins nino ninum passport pasaport reisepass personalausweis ausweis sozialversicherung steuerid".split())
_ID_FOLD = str.maketrans("ıſ", "is")


def finds(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in source positions, in order."""
    if not text or len(text) < 5:
        return []
    words = _LETTERS.findall(lower(text))
    t, at = transduce(text, words)
    if at is not None or not text.isascii():
        words = _LETTERS.findall(lower(t))
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))

    def take(start, end, kind):
        if not any(taken[start:end]):
            found.append((start, end, kind))
            taken[start:end] = b"\x01" * (end - start)

    have = set(words)
    if "@" in t or "%40" in t or "&#64;" in t or not have.isdisjoint(("at", "et", "a")) and _EMAIL_HINT.search(t):
        plain, source = undisguise(t) if _EMAIL_HINT.search(t) else (t, None)
        for m in EMAIL.finditer(plain):
            # an address begins and ends with characters of its own
            s, e = m.span() if source is None else (source[m.start()], source[m.end() - 1] + 1)
            if t[s:e].lower().startswith("git@") or t[e : e + 1] == ":" and re.match(r":[\w~./-]+/", t[e:]) or re.match(r"/[\w-]+/", t[e:]) and t[:s].endswith("://"):
                continue
            take(s, e, "email")
    # re.I takes ı for i and ſ for s
    labels = have if t.isascii() else {w.translate(_ID_FOLD) for w in have}
    if not labels.isdisjoint(_ID_WORDS) or any(w.startswith(_ID_BEGIN) for w in labels):
        for m in ID_NUMBER.finditer(t):
            s, e = m.span("v") if m.group("v") else m.span("w")
            if 7 <= sum(c.isalnum() for c in t[s:e]) <= 13:
                take(s, e, "id_number")
    if not have.isdisjoint(_STREET_WORDS):
        for m in ADDRESS_EN.finditer(t):
            take(*m.span(), "address")
    if not have.isdisjoint(_STREET_TR):
        for m in ADDRESS_TR.finditer(t):
            take(*m.span(), "address")
    if any(w.endswith(_STREET_DE) for w in have):
        for m in ADDRESS_DE.finditer(t):
            take(*m.span(), "address")
    if _PHONE_HINT.search(t):
        for m in PHONE.finditer(t):
            s, e = m.span()
            while e > s and not t[e - 1].isdigit():
                e -= 1
            v = t[s:e]
            if v.count("(") == v.count(")") and valid_phone(v, t[max(0, s - 40) : s]):
                take(s, e, "phone")
    if any((w[-ENDING:] in names.endings and len(w) > ENDING or w in names.short) and w not in names.ordinary for w in words):
        for s, e in names.find(t):
            take(s, e, "name")
    if at is not None:
        found = [(at[s], at[e] if t[e : e + 1] == "\x00" else at[e - 1] + 1, k) for s, e, k in found]
    return sorted(found)


def replace(text: str | None, names: Names) -> str | None:
    """The text with each find replaced by its typed placeholder."""
    got = finds(text, names)
    if not got:
        return text
    out, last = [], 0
    for s, e, kind in got:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join(out) + text[last:]


# --- learning the surname model --------------------------------------------
def _beside(t: str, given: frozenset[str], beside: Counter, lead: Counter) -> None:
    """Count the words after, before and, with a comma, turned around known given names."""
    words = [(m.start(), m.end(), m.group()) for m in _WORDS.finditer(t)]
    for k, (s, e, w) in enumerate(words):
        g = lower(w)
        if g not in given or s and t[s - 1] in "_.@/+-" or t[e : e + 1] in ("_", "@", "/"):
            continue
        n = k + 1
        if n < len(words) and len(words[n][2]) == 1 and t[words[n][1] : words[n][1] + 1] == ".":
            n += 1
        if n < len(words):
            ns, ne, nw = words[n]
            if t[ns - 1].isspace() and t[ne : ne + 1] not in ("_", "@", "/") and (n > k + 1 or t[e:ns].isspace()):
                for part in lower(nw).split("-"):
                    beside[g, part] += 1
        if k:
            ps, pe, pw = words[k - 1]
            between = t[pe:s]
            if between.isspace():
                lead[lower(pw)] += 1
            elif between[0] == "," and between[1:].isspace() and not (ps and t[ps - 1] in "_.@/+-"):
                for part in lower(pw).split("-"):
                    beside[g, part] += 1


def _observe(given: frozenset[str]):
    def run(batches):
        for b in batches:
            beside: Counter = Counter()
            every: Counter = Counter()
            large: Counter = Counter()
            lead: Counter = Counter()
            for t in b.column("content").to_pylist():
                free = _FREE.findall(t)
                low = [lower(w) for w in free]
                every.update(low)
                large.update(lower(w) for w in free if not w.islower())
                if not given.isdisjoint(low):
                    _beside(t, given, beside, lead)
            rows = [(w, g, n) for (g, w), n in beside.items()]
            for kind, counts in (("\x00n", every), ("\x00large", large), ("\x00lead", lead)):
                rows += [(w, kind, n) for w, n in counts.items()]
            yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "given": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return run


def learn(df: DataFrame, given: DataFrame, id_col: str = "id", text_col: str = "content") -> Names:
    """The bounded name model, from counts over all texts."""
    listed = given.select("given_name").filter("given_name is not null").distinct()
    if listed.count() > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    known = frozenset(lower(r[0].strip()) for r in listed.collect())
    if not known:
        return Names(set(), set(), set(), set())
    texts = df.select(F.col(text_col).alias("content")).filter("content is not null")
    counts = Scratch(df.sparkSession).save(texts.mapInArrow(_observe(known), "word string, given string, n long").groupBy("word", "given").agg(F.sum("n").alias("n")), "counts")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("given") == kind, F.col("n"))), F.lit(0))
    every, led, pairs_n = counts.agg(of("\x00n"), of("\x00lead"), F.coalesce(F.sum(F.when(~F.col("given").startswith("\x00"), F.col("n"))), F.lit(0))).first()
    words = counts.groupBy("word").agg(of("\x00n").alias("n"), of("\x00large").alias("large"), of("\x00lead").alias("lead"), F.coalesce(F.sum(F.when(~F.col("given").startswith("\x00"), F.col("n"))), F.lit(0)).alias("beside"))
    # ordinary: seen in lower case, and seldom beside a known given name
    usual = (F.col("large") * 2 <= F.col("n")) & (F.col("beside") * 8 < F.col("n"))
    hashes = lambda rows: Hashed(rows.select(F.xxhash64("word").alias("h")).toArrow().column("h").to_numpy())
    ordinary = hashes(words.filter(usual & (F.col("n") >= max(4, every / RARE_WORD))))
    before = hashes(words.filter(F.col("lead") >= max(3, led / RARE_WORD)))
    pairs = counts.filter(~F.col("given").startswith("\x00")).join(words.filter(~usual).select("word"), "word", "left_semi")
    # up to ENDING letters: whole words, mostly capital and mostly beside given names, of several of them
    own = words.filter(~usual & (F.col("large") * 2 > F.col("n")) & (F.col("beside") * 2 >= F.col("n")))
    short = pairs.filter(F.length("word").between(2, ENDING)).join(own.select("word"), "word", "left_semi").groupBy("word").agg(F.countDistinct("given").alias("g"), F.sum("n").alias("n"))
    short = short.filter((F.col("g") >= MIN_GIVEN) & (F.col("n") >= pairs_n / RARE_NAME))
    pairs = pairs.filter(F.length("word") > ENDING)
    endings = pairs.groupBy(F.expr(f"right(word, {ENDING})").alias("e")).agg(F.countDistinct("given").alias("g"), F.countDistinct("word").alias("w"), F.sum("n").alias("n"))
    endings = endings.filter((F.col("g") >= MIN_GIVEN) & (F.col("w") >= 2) & (F.col("n") >= pairs_n / RARE_NAME))
    return Names(set(known), {r.e for r in endings.collect()}, ordinary, before, {r.word for r in short.collect()})


def _finder(names: Names):
    def run(batches):
        for b in batches:
            ids, kinds, texts = [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("content").to_pylist()):
                for kind, s in dict.fromkeys((k, t[s:e]) for s, e, k in finds(t, names)):
                    ids.append(i)
                    kinds.append(kind)
                    texts.append(s)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "pii_kind": pa.array(kinds, pa.string()), "pii_text": pa.array(texts, pa.string())})

    return run


def personal_information(df: DataFrame, given: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, pii_kind, pii_text): the typed finds of every text."""
    names = learn(df, given, id_col, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")).filter("content is not null")
    return rows.mapInArrow(_finder(names), "id long, pii_kind string, pii_text string")


def redacted(df: DataFrame, given: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, content): every row, with finds replaced by typed placeholders."""
    names = learn(df, given, id_col, text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "content": pa.array([replace(t, names) for t in b.column("content").to_pylist()], pa.string())})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")).mapInArrow(run, "id long, content string")
