"""Tokens of free text for the entity model, and their features.

Email-like, phone-like and number-like runs are one token each, so that the model
decides by their shape and their surroundings.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_DOT = r"(?:\s?\.\s?|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_HOST = r"[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[\w-]+)+"
_PATTERNS = (
    ("mail", rf"[\w%+-]+(?:\.[\w%+-]+)*(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?){_HOST}|[\w%+-]+(?:\.[\w%+-]+)*\sat\s[\w-]+(?:\sdot\s[\w-]+)+"),
    ("said", rf"\b{_DIGIT_WORD}(?:[\s,-]+{_DIGIT_WORD}){{6,}}\b"),
    ("code", r"[^\W\d_]{1,5}[-/]\d[\w/-]*|[^\W\d_]\d{1,2}\.\d+"),
    ("iden", r"\b[^\W\d_]{1,6}\d{4,9}[^\W\d_]?\b|\b[^\W\d_]{2}\s\d\d\s\d\d\s\d\d\s[^\W\d_]\b"),
    ("digs", r"(?:\+\s?|\(\s?)?\d(?:\)?[\s.-]{0,2}\(?\d){6,}(?!\d|[.,]\d)"),
    ("numb", r"\d+(?:[.,/:]\d+)*[^\W\d_]?\b|\d+"),
    ("word", r"(?:[^\W\d_]|[ऀ-ॣॱ-ॿ])+(?:['’-](?:[^\W\d_]|[ऀ-ॿ])+)*"),
    ("line", r"\n"),
    ("sign", r"[^\w\s]|_"),
)
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS), re.IGNORECASE)
# Most words can begin none of the composite tokens; they are taken first.
_PLAIN = rf"(?!{_DIGIT_WORD}\b)[^\W\d_]{{3,}}(?=[\s,;:?!)])(?!\s?[@\[({{]|\sat\s)"
_ALL = re.compile("|".join([_PLAIN, *(f"(?:{p})" for _, p in _PATTERNS)]), re.IGNORECASE)

#: The tokens of a text as strings, and as matches.
strings, iterate = _ALL.findall, _ALL.finditer


def kind_of(s: str) -> str:
    """The type of a token from its string."""
    m = _TOKEN.fullmatch(s)
    return m.lastgroup if m else "word" if s[0].isalpha() else "sign"


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every token."""
    return [(m.start(), m.end(), kind_of(m.group())) for m in iterate(text)]


def shape(s: str, kind: str) -> str:
    if kind in ("mail", "said", "line"):
        return kind
    if kind == "word":
        if not s[0].isascii() and "ऀ" <= s[0] <= "ॿ":
            return "deva"
        body = "X" if s.isupper() and len(s) > 1 else "x" if s.islower() else "Xx" if s[0].isupper() else "xX"
        return f"word{body}{1 if len(s) == 1 else ''}"
    return kind + re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", s))[:20]


def token_features(s: str, kind: str, known: set[str]) -> list[str]:
    """Features of a token by itself: form, letters, and whether it is a common word."""
    low = s.lower() if kind in ("word", "sign", "line") else shape(s, kind)
    sh = shape(s, kind)
    if kind != "word":
        return ["b", "s=" + sh, "k=" + kind]
    common = low in known
    return ["b", "s=" + sh, "k=word", *(["w=" + low] if common else ["rare", "rare" + sh, "p=" + low[:2], "e=" + low[-3:], "e2=" + low[-2:]])]


def context_features(s: str, kind: str, known: set[str]) -> list[str]:
    """What a token says to its neighbours."""
    if kind != "word":
        return ["c=" + (s if kind == "sign" else shape(s, kind)[:12])]
    low = s.lower()
    return ["c=" + low] if low in known else ["crare", "crare" + shape(s, kind)]


#: Offsets of the neighbours that a token looks at.
AROUND = (-3, -2, -1, 1, 2, 3)
