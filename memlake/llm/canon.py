"""Canonical forms of texts that differ in formatting alone.

Two keys for each text: of its runs of letters and digits in order, and, if it
consists wholly of labelled fields, of its set of (label, value) pairs in any
order and notation.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

RUN = re.compile(r"[^\W_]+")
#: Of the ASCII characters letters in lower case and digits, blanks for all others.
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))

#: One field of labelled text: separator, decoration, label, decoration, sign.
_FIELD = re.compile(
    r"(?:^|[|;\n\r,])[\s>#*•·\-–—+|]*(?:\d+[.)]\s+)?[\[({<\"'`*_]*"
    r"([^\W\d_]{2,20})"
    r"[\])}>\"'`*_]*\s*(?::|=>|=|->|→)[*_]*(?!//)",
)
_BRACKETED = re.compile(r"(?:^|[|;\n\r])[\s*•\-]*(?:\[([^\W\d_]{2,20})\]|<([^\W\d_]{2,20})>)\s*")
_HEADING = re.compile(r"(?:^|[\n\r])\s*(?:#{1,6}\s*|\*\*)([^\W\d_]{2,20})(?:\*\*)?\s*:?\s*[\n\r]")
_XML = re.compile(r"<([^\W\d_]{2,20})>(.*?)</\1>", re.S)
#: Labels that make a comma an acceptable separator between fields.
_SEP_COMMA = re.compile(r",\s*$")


def fold(text: str) -> str:
    """Lower case by way of upper case, so that every case variant of a letter meets."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).upper().lower().replace("i̇", "i")
    return t


def runs(text: str) -> list[str]:
    return text.translate(_ASCII).split() if text.isascii() else RUN.findall(fold(text))


def _key(kind: str, text: str) -> bytes:
    return hashlib.blake2b(f"{kind}\x00{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _plain(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def fields(text: str) -> list[tuple[str, str]] | None:
    """The labelled fields of a text that consists wholly of them, else None."""
    t = text.strip()
    if not t:
        return None
    if t[0] == "{" and t[-1] == "}":
        try:
            got = json.loads(t, object_pairs_hook=lambda x: x, strict=False)
            if isinstance(got, list) and got and all(isinstance(k, str) for k, _ in got):
                return [(k, _plain(v)) for k, v in got]
        except (ValueError, RecursionError):
            pass
        t = t[1:-1].strip()
    if t[:1] == "<":
        rest, found = _XML.sub("", t), _XML.findall(t)
        if found and not RUN.search(rest):
            return found
    first = RUN.search(t)
    for pattern in (_FIELD, _BRACKETED, _HEADING) if first else ():
        # no run may stand before the first field
        if any(pattern.match(t, at) for at in range(first.start() + 1)):
            marks = list(pattern.finditer(t))
            ends = [m.start() for m in marks[1:]] + [len(t)]
            return [(next(g for g in m.groups() if g), t[m.end() : e]) for m, e in zip(marks, ends)]
    return None


def keys(text: str | None, found: list[str] | None = None) -> tuple[bytes, bytes | None]:
    """(key of the runs in order, key of the labelled fields or None). A null counts as an empty text; ``found`` are its runs, where they are known."""
    text = text or ""
    seq = _key("s", " ".join(runs(text) if found is None else found))
    got = fields(text)
    if not got:
        return seq, None
    return seq, _key("f", "\x01".join(sorted("\x02".join(runs(k)) + "\x03" + " ".join(runs(v)) for k, v in got)))
