"""Column expressions for lines, headings, replies and prompts; no Python UDFs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a line a section title wherever they stand in it.
SECTION_KEYWORDS = ("coverage", "exclusion", "claim", "definition", "eligibility", "benefit", "policy", "general conditions")

# Everyday wording and the term that replaces it in a rewritten question.
GLOSSARY = {
    "doctor fees": "consultation charges",
    "hospital stay": "inpatient hospitalization",
    "insurance amount": "sum insured",
    "things not covered": "policy exclusions",
    "time before coverage starts": "waiting period",
    "medicine costs": "pharmaceutical expenses",
    "room cost": "room rent limit",
}

# What is shown where an answer or a justification is empty, and the
# labels and rules of prompts, contexts and source lists.
NO_ANSWER, NO_JUSTIFICATION = "No answer returned.", "No justification returned."
REFERENCE = "Referenced from Section: "
DASH = "—"

# Openings of questions that need no document (greetings, thanks, small talk).
DIRECT_PATTERN = r"^(hi|hello|hey|good (morning|afternoon|evening)|thanks|thank you|who are you|what can you do)\b"

# Layouts of a context and of a prompt's numbered listing.
RULE = "-" * 80
CONTEXT_LAYOUT = "[Document: {document}]\n[Section: {section}]\nContent: {text}\n" + RULE + "\n"
LISTING_LAYOUT = "\nChunk {number}:\nSection: {section}\n{label}: {text}\n" + RULE + "\n"
#: What stands in a layout where a chunk has nothing.
MISSING = "None"


def strip(c: Column | str) -> Column:
    """Without white space at both ends, as Unicode defines it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    """White-space words of a stripped, non-empty text; 0 for an empty one."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, r"(?U)\s+")))


def is_heading(line: Column | str) -> Column:
    """Whether a line looks like a section title.

    True for a non-empty stripped line that is short (12 words at most) without a
    final period, starts with a number and ``.``/``)`` or a Roman numeral and
    ``.``, is all upper case, is title case of at most 8 words, or contains a
    section keyword.  Null gives null.
    """
    return stripped_is_heading(strip(line))


def stripped_is_heading(s: Column) -> Column:
    """``is_heading`` of a line that is stripped already."""
    n = word_count(s)
    upper = s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]")
    title = s.rlike(r"[\p{Lu}\p{Lt}]") & ~s.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]")
    keyword = F.lower(s).rlike("|".join(SECTION_KEYWORDS))
    numbered = s.rlike(r"(?U)^(\d+[.)]|[IVX]+\.)")
    # "Or" ends at the first true test, so the cheap ones come first.
    return (s != "") & ((~s.endswith(".") & (n <= 12)) | keyword | numbered | upper | (title & (n <= 8)))


def rewrite_question(question: Column | str) -> Column:
    """The question with everyday wording replaced by its term; null stays null."""
    c = F.col(question) if isinstance(question, str) else question
    return strip(reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), GLOSSARY.items(), c))


def normal_route(reply: Column | str) -> Column:
    """``rag`` or ``direct`` from a classifier's reply; anything unclear is ``rag``."""
    r = F.lower(strip(reply))
    return F.when(r.contains("rag"), "rag").when(r.contains("direct"), "direct").otherwise("rag")


def question_route(question: Column | str) -> Column:
    """Keyword stand-in of the classifier."""
    return F.when(F.lower(strip(question)).rlike(DIRECT_PATTERN), "direct").otherwise("rag")


def parsed_answer(reply: Column | str) -> Column:
    """The text before the first ``Justification:`` without any ``Answer:``."""
    return strip(F.replace(F.get(F.split(reply, "Justification:"), F.lit(0)), F.lit("Answer:"), F.lit("")))


def parsed_justification(reply: Column | str) -> Column:
    """The justification, led by its section reference if it has one; else empty."""
    part = F.get(F.split(reply, "Justification:"), F.lit(1))
    section = F.get(F.split(part, "Referenced from Section:"), F.lit(1))
    return F.when(part.isNull(), F.lit("")).when(section.isNotNull(), F.concat(F.lit(REFERENCE), strip(section))).otherwise(strip(part))


def parsed_indices(reply: Column | str, n: Column, k: int) -> Column:
    """Chunk positions named by a re-ranker's reply.

    Only digits and commas of the first line count; the list is cut to ``k``
    before positions of ``n`` and more are dropped.  The first ``k`` positions
    stand in where nothing valid is left.
    """
    line = F.split_part(strip(reply), F.lit("\n"), F.lit(1))
    parts = F.filter(F.split(F.regexp_replace(line, "[^0-9,]", ""), ","), lambda x: x != "")
    named = F.filter(F.slice(F.transform(parts, lambda x: x.try_cast("bigint")), 1, k), lambda x: x < n)
    first = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda x: x < n)
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(first)


def strict_indices(reply: Column | str, n: Column, k: int) -> Column:
    """Positions of a comma list read strictly, the other re-ranker's form.

    Any part that is no integer, or lies before the first chunk when counted from
    the end, gives the first ``k`` positions; positions of ``n`` and more are
    dropped even if nothing is left.  Negative numbers count from the end.
    """
    parts = F.slice(F.transform(F.split(reply, ","), lambda x: strip(x)), 1, k)
    whole = F.forall(F.transform(F.split(reply, ","), lambda x: strip(x)), lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"))
    numbers = F.filter(F.transform(parts, lambda x: x.try_cast("bigint")), lambda x: x < n)
    placed = F.transform(numbers, lambda x: F.when(x < 0, x + n).otherwise(x))
    first = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda x: x < n)
    return F.when(F.coalesce(whole, F.lit(False)) & ~F.exists(placed, lambda x: x < 0), placed).otherwise(first)


def context_string(chunks: Column) -> Column:
    """All chunks with document, section and content, a rule after each; empty for none."""
    one = lambda c: _laid_out(CONTEXT_LAYOUT, c, ("document", "section", "text"))
    return F.coalesce(F.array_join(F.transform(chunks, one), "\n"), F.lit(""))


def _laid_out(layout: str, chunk: Column, fields: tuple[str, ...], **more: Column) -> Column:
    return fill(layout, **{f: F.coalesce(chunk[f], F.lit(MISSING)) for f in fields}, **more)


def shown_answer(answer: Column | str) -> Column:
    """The answer as it is shown; a default for an empty one."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.when(c.isNull() | (c == ""), NO_ANSWER).otherwise(c)


def shown_justification(justification: Column | str, sources: Column | str) -> Column:
    """The justification followed by its sources as they are shown, or a default."""
    j = F.coalesce(justification, F.lit(""))
    src = F.col(sources) if isinstance(sources, str) else sources
    listed = F.concat(F.lit("Sources:\n"), F.array_join(F.transform(src, lambda x: F.concat(F.lit("- "), F.coalesce(x["document"], F.lit("null")), F.lit(" :: "), F.coalesce(x["section"], F.lit("null")))), "\n"))
    both = F.when(F.coalesce(F.size(src), F.lit(0)) > 0, F.when(j != "", F.concat(j, F.lit("\n\n"), listed)).otherwise(listed)).otherwise(j)
    return F.when(both == "", NO_JUSTIFICATION).otherwise(both)


def shown_resource(kind: Column | str, name: Column | str) -> Column:
    """``kind: name`` of an audit row's resource, a dash where it has no kind."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isNull() | (k == ""), DASH).otherwise(F.concat(k, F.lit(": "), F.coalesce(name, F.lit("None"))))


def or_default(value: Column | str, default: Column) -> Column:
    """The default in place of a null, an empty text, zero, false or an empty array or map."""
    c = F.col(value) if isinstance(value, str) else value
    shown, text = c.cast("string"), F.typeof(c) == "string"
    return F.when(c.isNull() | (text & (shown == "")) | (~text & shown.isin("0", "0.0", "false", "[]", "{}")), default).otherwise(c)


def iso_time(us: Column | str) -> Column:
    """Microseconds since 1970 as ISO text in UTC, with a fraction only if there is one."""
    u = (F.col(us) if isinstance(us, str) else us).cast("bigint")
    second = F.floor(u / 1_000_000).cast("bigint")
    day = F.floor(second / 86_400).cast("int")
    clock = F.pmod(second, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.concat_ws(":", two(F.floor(clock / 3600)), two(F.floor(clock % 3600 / 60)), two(clock % 60))
    part = F.pmod(u, F.lit(1_000_000))
    fraction = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), time, fraction, F.lit("+00:00"))


def utc_micros(text: Column | str) -> Column:
    """Microseconds of an ISO time; one without a zone is taken as UTC; null if broken."""
    c = F.col(text) if isinstance(text, str) else text
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("+00:00")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def fill(template: str, **values: Column) -> Column:
    """A prompt: the template with its ``{name}`` places filled; a null counts as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def merged(*maps: Column) -> Column:
    """One map of several; where keys clash, the last one's value counts; nulls are empty."""
    empty = F.create_map().cast("map<string,string>")
    out = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        new = F.coalesce(m, empty)
        old = F.map_filter(out, lambda k, _: ~F.array_contains(F.map_keys(new), k))  # noqa: B023
        out = F.map_concat(old, new)
    return out


def preview(text: Column | str, size: int = 200) -> Column:
    """The first characters and ``...``, which is always added."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def listing(chunks: Column, first: int, label: str) -> Column:
    """Numbered chunk listing of a prompt; ``chunks`` holds ``section`` and ``text``."""
    one = lambda c, i: _laid_out(LISTING_LAYOUT, c, ("section", "text"), number=i + first, label=F.lit(label))
    return F.array_join(F.transform(chunks, one), "")


def password_problem(c: Column | str, least: int = 12) -> Column:
    """The first rule a password breaks, or an empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(F.length(c) < least, "length")
        .when(~c.rlike(r"\p{Ll}"), "lowercase")
        .when(~c.rlike(r"\p{Lu}"), "uppercase")
        .when(~c.rlike(r"\p{Nd}"), "digit")
        .otherwise("")
    )
