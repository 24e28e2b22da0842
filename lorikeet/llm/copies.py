"""Answers that say nothing of their own: placeholders, and copies of the question."""

from __future__ import annotations

import re

import zstandard

#: A copy costs at most this many bytes beyond the question it is compressed with,
#: and at most this share of what it costs alone.
MOST_BYTES, MOST_SHARE, LEAST_LENGTH = 44, 0.62, 0.6
#: Share of an answer's words that stand in the question too; below it, nothing is compressed.
SHARED = 0.5

# Answers that say nothing.
PLACEHOLDERS = ("", "n/a", "none", "null", "nil", "nan", "answer", "tbd", "undefined", "empty", "no answer", "blank", "placeholder", "antwort", "respuesta", "réponse", "उत्तर")

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in folded letter case."""
    return _WORD.findall(text.casefold())


_SAYS_NOTHING = frozenset("".join(words(p)) for p in PLACEHOLDERS)
_LONGEST = max(map(len, _SAYS_NOTHING))
_PLAIN = zstandard.ZstdCompressor(level=1, write_content_size=False)


def says_nothing(ws: list[str]) -> bool:
    return len(ws) <= _LONGEST and "".join(ws) in _SAYS_NOTHING


def is_empty(answer: str | None) -> bool:
    """Whether the answer is null, blank or only a placeholder."""
    return answer is None or says_nothing(words(answer))


def copies(q: list[str], a: list[str]) -> bool:
    """``is_copy`` of the words of question and answer."""
    if not q or not a:
        return False
    if q == a:
        return True
    if sum(map(set(q).__contains__, a)) < SHARED * len(a):
        return False
    qb, ab = " ".join(q).encode(), " ".join(a).encode()
    if len(ab) < LEAST_LENGTH * len(qb):
        return False
    d = zstandard.ZstdCompressionDict(qb * (1 + 8 // len(qb)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own = len(zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_dict_id=False).compress(ab))
    return own <= MOST_BYTES and own <= MOST_SHARE * len(_PLAIN.compress(ab))


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer, in any letter case, punctuation or wrapping, is the question.

    An answer of the question's words alone is one.  Another whose words are mostly
    the question's is compressed with the question as a raw zstandard dictionary:
    what it still costs is what it adds.
    """
    return copies(words(question), words(answer))
