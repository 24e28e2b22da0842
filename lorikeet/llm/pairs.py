"""Unusable question and answer pairs, each with one kind of defect.

Every pair is judged on its own, in one pass: empty answers by a placeholder
list, copies by compressing the answer with the question as a zstandard
dictionary, refusals by dictionaries of declining, failing and polite sentences
(every sentence must be one), and other languages by function words and script.
Truncated answers come from the terminal-context operator over all answers.
Where several fit, the first of ``DEFECTS`` counts.

Null and blank answers are empty; a null question has no copy and no language;
repeated rows give one row; null ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.copies import copies, says_nothing, words
from lorikeet.llm.languages import asked_language, language_of
from lorikeet.llm.literals import Gate
from lorikeet.llm.truncation import find_truncated

DEFECTS = ("empty_answer", "copies_question", "refusal", "truncated_answer", "other_language")

# Openings of a sentence that declines, fails or finds nothing.
REFUSALS = {
    "en": [
        r"(?:can ?not|can['’]t|could not|couldn['’]t|unable to|not able to|won['’]t|will not|must decline|have to decline|not (?:allowed|permitted|authori[sz]ed)|decline to)\b.{0,60}\b(?:help|answer|assist|discuss|respond|comment|advise|say|provide|share|process|complete|guidance|find|locate|give)",
        r"(?:be|been) answered here|cannot be answered|can['’]t be answered",
        r"(?:isn['’]t|is not|not) something i(?:['’]m| am)? ?(?:permitted|allowed|able)",
        r"would(?: not|n['’]t) be appropriate",
        r"outside what (?:i|we) can",
        r"(?:something|it) went wrong|service is (?:busy|unavailable|down)|timed out|internal error|an error occurred",
        r"no (?:answer|reply|response) (?:could|can|is|was|on)\b",
        r"(?:declined|blocked|rejected|stopped) by the .{0,20}filter|request (?:was )?declined",
        r"(?:contain|contains|have|has|say|says|found|find) (?:nothing|no (?:information|mention|details?))",
        r"(?:do not|don['’]t|did not|didn['’]t) have (?:enough|any|the) (?:context|information|details?)",
        r"there is no (?:mention|information|record|reference)\b.{0,80}(?:say|files|documents|uploaded|provided|answer)",
        r"(?:could not|couldn['’]t|did not|didn['’]t|unable to) (?:find|locate|retrieve)",
    ],
    "es": [r"no (?:puedo|podemos|es posible)\b.{0,40}(?:responder|ayudar|contestar|opinar|comentar|atender|dar)", r"no estoy autorizad", r"no (?:encontr|se encontr|hall)\w*\b.{0,30}(?:informaci|nada|datos)", r"no hay informaci", r"se produjo un error|algo salió mal"],
    "de": [r"(?:kann|können|darf|dürfen)\b.{0,50}\b(?:nicht|keine|leider)\b.{0,40}(?:beantworten|helfen|geben|äußern|auskunft)", r"findet sich\b.{0,30}(?:nichts|keine)", r"keine (?:informationen?|angaben)\b.{0,30}gefunden", r"(?:fehler aufgetreten|etwas ist schiefgelaufen)"],
    "fr": [r"(?:ne peux|ne pouvons|ne suis) pas\b.{0,40}(?:répondre|aider|autoris|donner|commenter)", r"(?:pas trouvé|aucune information)", r"une erreur s['’]est produite"],
    "hi": [r"(?:उत्तर|जवाब|जानकारी|सहायता|मदद|सलाह|टिप्पणी).{0,40}नहीं.{0,6}(?:दे सक|कर सक|मिल|है)", r"नहीं मिल[ाीे]", r"त्रुटि|गड़बड़"],
}

# Sentences that only accompany a refusal.
COURTESIES = [
    r"(?:i['’]?m |we['’]?re )?(?:very |so )?sorry\b.{0,40}|(?:my|our) apologies|i apologi[sz]e.{0,40}|unfortunately",
    r"thank(?:s| you)\b.{0,40}|take care|have a (?:nice|good) day|please (?:try|contact|ask|rephrase|reach|consult|check)\b.{0,80}|try again\b.{0,30}|(?:kindly )?contact\b.{0,60}|ask\b.{0,60}|does this help|let me know\b.{0,60}",
    r"lo siento|disculpe|gracias.{0,30}|consulte\b.{0,60}|leider|entschuldigung.{0,40}|danke.{0,30}|bitte wenden\b.{0,60}|désolé.{0,30}|merci.{0,30}|क्षमा करें|धन्यवाद.{0,30}|कृपया\b.{0,60}",
]

_PATTERNS = [p for ps in REFUSALS.values() for p in ps]
_REFUSAL = re.compile("|".join(_PATTERNS), re.IGNORECASE | re.DOTALL)
_MAY_REFUSE = Gate(_PATTERNS)
_COURTESY = re.compile(r"\W*(?:" + "|".join(COURTESIES) + r")\W*", re.IGNORECASE | re.DOTALL)
_SENTENCES = re.compile(r"(?<=[.!?।])\s+|\n+")


def is_refusal(answer: str) -> bool:
    """Whether every sentence declines, fails, finds nothing or is polite, and one does not only the last."""
    if not _MAY_REFUSE(answer.lower()):
        return False
    refused = False
    for s in _SENTENCES.split(answer.strip()):
        if not s.strip():
            continue
        if _MAY_REFUSE(s.lower()) and _REFUSAL.search(s):
            refused = True
        elif not _COURTESY.fullmatch(s) and any(c.isalnum() for c in s):
            return False
    return refused


def own_defect(question: str | None, answer: str | None) -> str | None:
    """The defect that the pair alone shows, truncation left out."""
    if answer is None or says_nothing(a := words(answer)):
        return "empty_answer"
    q = [] if question is None else words(question)
    if copies(q, a):
        return "copies_question"
    if is_refusal(answer):
        return "refusal"
    if q and (la := language_of(answer, a)) and (lq := language_of(question, q)) and la != lq and la not in asked_language(question):
        return "other_language"
    return None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(i, d) for i, q, a in zip(*(c.to_pylist() for c in b.columns)) if (d := own_defect(q, a))]
        yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], names=["id", "defect"])


def broken_pairs(df: DataFrame, key: Column | str, question: Column | str, answer: Column | str) -> DataFrame:
    """``id, defect`` of every unusable pair, at most one row per id."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).cast("bigint").alias("id"), col(question).alias("q"), col(answer).alias("a")).where("id is not null")
    own = rows.mapInArrow(_judge, "id bigint, defect string")
    cut = find_truncated(rows.select(F.col("id").alias("key"), F.col("a").alias("text"), F.col("q").alias("prompt")))
    both = own.unionByName(cut.select(F.col("key").alias("id"), F.lit("truncated_answer").alias("defect")))
    rank = F.array_position(F.lit(list(DEFECTS)), F.col("defect"))
    return both.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "defect")).alias("d")).select("id", "d.defect")
