"""Language of a short text from its script and its function words."""

from __future__ import annotations

import re

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of is for to in an what how does which when can you are not be or under if with at on by from this that i my your it was has have any do will yes only up after before days months please why who covered unless until each",
    "es": "el la los las de del que en un una por para con se su al es si cuando según qué cuánto cuándo cómo puedo desde hasta sí días meses está salvo siempre o antes durante",
    "de": "der die das und ist für von zu den dem ein eine nicht mit wird werden wenn ich auf bei nach wie lange kann welche gilt auch bis ja nein tagen tage monaten sofern falls es dass zur dazu sich",
    "fr": "le la les des du de et est pour que dans un une sur avec pas sont qui quand comment jours mois si aux au ou lorsque oui non sauf puis",
}

# Signs that speak for a language.
SIGNS = {"es": "ñ¿¡áíóú", "de": "äöüß", "fr": "àâçèêëîïôœùû"}

# Names of languages in requests for an answer in one of them.
LANGUAGE_NAMES = {
    "en": "english inglés englisch anglais अंग्रेज़ी अंग्रेजी",
    "es": "spanish español spanisch espagnol स्पेनिश",
    "de": "german alemán deutsch allemand जर्मन",
    "fr": "french francés französisch français फ्रेंच",
    "hi": "hindi हिंदी हिन्दी",
}

_OF: dict[str, list[str]] = {}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in _ws.split():
        _OF.setdefault(_w, []).append(_lang)
_NAME = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_ASKS = re.compile(
    r"(?:\b(?:in|en|auf|into)\s+(?P<a>" + "|".join(n for n in _NAME if n.isascii() or n[0] < "ऀ") + r")\b|(?P<b>" + "|".join(n for n in _NAME if n[0] >= "ऀ") + r")\s+में)", re.IGNORECASE
)


def language_of(text: str, words: list[str]) -> str | None:
    """``language`` of a text whose folded words are known."""
    plain = text.isascii()
    if not plain and (n := len(_DEVANAGARI.findall(text))) and 3 * n > len(_LETTERS.findall(text)):
        return "hi"
    count = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        if w in _OF:
            for lang in _OF[w]:
                count[lang] += 1
    if not plain:
        low = set(text.lower())
        for lang, signs in SIGNS.items():
            count[lang] += len(low.intersection(signs))
    first, second = sorted(count.values())[:-3:-1]
    return max(count, key=count.get) if first > second else None


def language(text: str) -> str | None:
    """``en es de fr hi``, or None where nothing tells or two are equally likely."""
    return language_of(text, _WORD.findall(text.casefold()))


def asked_language(question: str) -> set[str]:
    """Languages that a question asks to be answered in."""
    return {_NAME[(m["a"] or m["b"]).lower()] for m in _ASKS.finditer(question)}
