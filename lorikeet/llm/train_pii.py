"""Trains the entity model: ``python -m lorikeet.llm.train_pii TABLE_DIR``.

No text of the tables is kept.  Names are mined by a few introducing phrases and
then labelled wherever a full name of these parts stands; the other kinds are
labelled by their forms.  To make the model look at context and form rather than
at the parts it happened to see, names and places are replaced by invented ones
and letter case is changed in a share of the copies.  The weights of the skip edges are
learned last, with all others fixed, from texts in which a name is mentioned again
at a neutral place, and from texts in which the name of an organisation is.

A first model is trained without a fifth of the name parts and a fifth of the
wordings (texts with names, numbers and letter case masked); what it finds in the
texts held out is printed.  The labels there come from the same forms and mined
names as the training labels: these figures tell how well the model carries over to
other names and wordings, not how right the labels are.  The model that is kept is
trained on all texts.
"""

from __future__ import annotations

import heapq
import json
import random
import re
import sys
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow.parquet as pq
import xxhash

from lorikeet.llm import crf
from lorikeet.llm.pii import AGREEING, MODEL, SKIPS, Tagger, agreement
from lorikeet.llm.pii_tokens import AROUND, KINDS, LABELS, context_features, token_features, tokens

#: Most distinct texts taken per table (drawn by their hash from all rows), and most
#: texts without any item used as counter-examples, brief and long ones.
MOST_ROWS, MOST_PLAIN, BRIEF = 40_000, 2500, 60
#: Texts made for the skip edges, and steps of their learning.
MENTIONS, STEPS = 1200, 60
HELD = 5

_N = r"((?:[A-Z][\w'’-]+) (?:[A-Z]\. )?(?:de )?[A-Z][\w'’-]+|[A-Z][\w'’-]+, [A-Z][\w'’-]+)"
_INTRO = [r"My name is {}", r"i am {} ph", r"^{} here", r"details: {},", r"father {},", r"daughter {} \(", r"covered for {}\?", r"Me llamo {} y", r"Ich heiße {},", r"Patient {} was", r"Member {} \(ID", r"kin {},", r"Mrs {} asked", r"Insured: {},", r"sent by {} from", r"regards\n{}"]
_HINDI = [r"मेरा नाम (\S+ \S+) है", r"फोन [^,]+, (\S+ \S+)$"]
_STREET = r"(?:street|st|road|rd|lane|avenue|drive|close|marg|nagar|cross road|court|way|square|terrace|gardens)"
ADDRESS = re.compile(
    rf"(?:(?:House No\.?|Flat|Plot|Door No\.?|Apartment|Apt\.?|Unit)\s+\d+[A-Za-z]?(?:/\d+)?,?\s+)?(?:\d+[A-Za-z]?,?\s+)?(?:[A-Z][\w'’-]+\s+){{1,3}}?{_STREET}\b\.?,\s+[A-Z][\w'’-]+(?:\s(?:East|West|North|South|Ellery|[A-Z][a-z]+(?=\s*(?:-|,?\s*PIN|\d))))?(?:(?:\s*-\s*|,?\s+PIN\s+|\s+)\d{{5,6}})?",
    re.IGNORECASE,
)
_PHONE = re.compile(r"^(?:\+\d{1,2} \(\d{3}\) \d{3}-\d{4}|\d{3}-\d{4}-\d{3}|\d{10}|\(\d{3}\) \d{3} \d\d \d\d \d\d|\+\d\d \d{5} \d{5}|\+\d\d\.\d{3}\.\d{3}\.\d{4}|\d{3} \d{4} \d{4})$")
_IDENT = re.compile(r"^(?:\d{3}-\d\d-\d{4}|\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]\d{7}|[A-Z]{2} \d\d \d\d \d\d [A-Z])$", re.IGNORECASE)


ORGANISATIONS = re.compile(r" (?:Institute|Hospital|Memorial|Eye Clinic|Clinic|Diagnostics|Nursing Home|Health|Assurance|Mutual|Life|General)\b", re.IGNORECASE)
ORGANISATION = re.compile(r"\b([A-Z][a-z]{3,}) (?:Institute|Hospital|Memorial|Eye Clinic|Clinic|Diagnostics|Nursing Home)\b")


def mined_names(texts: list[str]) -> tuple[set[str], set[str], set[str], set[str]]:
    given, family, hg, hf = set(), set(), set(), set()
    for t in texts:
        for p in _INTRO:
            for m in re.findall(p.format(_N), t, re.MULTILINE):
                b, _, a = m.partition(", ")
                if a:
                    given.add(a), family.add(b)
                else:
                    x = [y for y in m.split() if not re.fullmatch(r"[A-Z]\.", y)]
                    given.add(x[0]), family.add(" ".join(x[1:]))
        for p in _HINDI:
            for m in re.findall(p, t, re.MULTILINE):
                hg.add(m.split()[0]), hf.add(m.split()[1])
    low = lambda s: {x.lower() for x in s}
    return low(given), low(family), hg, hf


def label(text: str, names: re.Pattern, organisations: re.Pattern) -> list[tuple[int, int, str]]:
    spans = []
    for m in ADDRESS.finditer(text):
        lo = m.start()
        # The leading part of the pattern may swallow words before a designation.
        if d := re.search(r"(?:House No|Flat|Plot|Door No|Apartment|Apt|Unit)\b|\d", text[lo : m.end()], re.IGNORECASE):
            spans.append((lo + d.start(), m.end(), "address"))
    for a, b, k in tokens(text):
        s = text[a:b]
        if k in ("mail", "said"):
            spans.append((a, b, "email" if k == "mail" else "phone"))
        elif k in ("digs", "iden", "numb"):
            if _PHONE.match(s):
                spans.append((a, b, "phone"))
            elif _IDENT.match(s):
                spans.append((a, b, "id_number"))
    for m in names.finditer(text):
        if not organisations.match(text, m.end()):
            spans.append((m.start(), m.end(), "name"))
    out, last = [], 0
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s[0] >= last:
            out.append(s)
            last = s[1]
    return out


def labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[int]]:
    ts, ys = tokens(text), []
    for a, b, _ in ts:
        y = 0
        for lo, hi, k in spans:
            if a >= lo and b <= hi:
                first = not any(lo <= x < a for x, _, _ in ts)
                y = LABELS.index(("B-" if first else "I-") + k)
        ys.append(y)
    return ts, ys


def invented(rnd: random.Random, like: str) -> str:
    """A made-up word in the letter case of ``like``."""
    w = "".join(rnd.choice(["b", "br", "k", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w", "y", "z", "ch", "sh"]) + rnd.choice("aeiou") for _ in range(rnd.choice((2, 2, 3, 3, 4))))
    w += rnd.choice(["", "n", "r", "l", "s", "th", "ne", "by", "ton", "pur", "rd"])
    return w.upper() if like.isupper() else w if like.islower() else w.capitalize()


def changed(text: str, spans: list, rnd: random.Random) -> tuple[str, list]:
    """A copy with some name and place words replaced and perhaps other letter case."""
    out, new, at = [], [], 0
    for a, b, k in spans:
        out.append(text[at:a])
        s = text[a:b]
        if k == "name":
            s = re.sub(r"[^\W\d_]{2,}", lambda m: m.group() if m.group().lower() == "de" or "ऀ" <= m.group()[0] <= "ॿ" else invented(rnd, m.group()), s)
        elif k == "address" and rnd.random() < 0.6:
            s = re.sub(r"\b(?!House|Flat|Plot|No|PIN|Road|Rd|Street|St|Lane|Avenue|Drive|Close|Marg|Nagar|Cross|East|Port|Old)[A-Z][a-z]+", lambda m: invented(rnd, m.group()) if rnd.random() < 0.7 else m.group(), s)
        start = sum(map(len, out))
        out.append(s)
        new.append((start, start + len(s), k))
        at = b
    out.append(text[at:])
    t = "".join(out)
    r = rnd.random()
    if r < 0.12 and len(t.lower()) == len(t):
        t = t.lower()
    elif r < 0.2 and len(t.upper()) == len(t):
        t = t.upper()
    elif r < 0.4:
        t = "".join(s2 if not any(a <= i < b and k in ("name", "address") for a, b, k in new) else (s2.upper() if r < 0.3 else s2.lower()) for i, s2 in enumerate(t)) if len(t.upper()) == len(t) == len(t.lower()) else t
    return t, new


def features(text: str, ts: list, known: set[str]) -> list[list[str]]:
    own = [token_features(text[a:b], k, known) for a, b, k in ts]
    ctx = [context_features(text[a:b], k, known) for a, b, k in ts]
    n = len(ts)
    return [own[i] + [f"{o}{f}" for o in AROUND for f in (ctx[i + o] if 0 <= i + o < n else ["edge"])] for i in range(n)]


def drawn(texts: Iterable[str | None], most: int) -> list[str]:
    """At most so many distinct texts, those of the smallest hashes, out of all."""
    held: list[tuple[int, str]] = []
    seen: set[int] = set()
    for t in texts:
        if t and t.strip() and (h := xxhash.xxh64_intdigest(t)) not in seen:
            seen.add(h)
            if len(held) < most:
                heapq.heappush(held, (-h, t))
            elif -held[0][0] > h:
                heapq.heapreplace(held, (-h, t))
    return sorted(t for _, t in held)


def column(path: str, name: str) -> Iterable[str | None]:
    for b in pq.ParquetFile(path).iter_batches(columns=[name]):
        yield from b.column(0).to_pylist()


def wording(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with its items, numbers and letter case masked."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"<{k}>"]
        at = b
    return re.sub(r"\d+", "9", "".join([*out, text[at:]])).lower()


def known_words(found: list) -> set[str]:
    """Words met outside items at least three times and never in a name."""
    count, inside = Counter(), Counter()
    for t, s in found:
        for a, b, k in tokens(t):
            if k == "word":
                kinds = {kind for lo, hi, kind in s if lo <= a < hi}
                if not kinds & {"name", "address"}:
                    count[t[a:b].lower()] += 1
                if "name" in kinds:
                    inside[t[a:b].lower()] += 1
    return {w for w, n in count.items() if n >= 3 and inside[w] == 0} | set(re.findall(r"[a-z]+", _STREET)) | {"house", "flat", "plot", "no", "pin", "de"}


def with_mentions(found: list, known: set[str], rnd: random.Random, n: int) -> list[tuple[str, list]]:
    """Texts whose name, or whose organisation's name, stands again in a plain line."""
    named = [(t, s) for t, s in found if any(k == "name" for _, _, k in s)]
    places = [(t, m) for t, s in found if not s and (m := ORGANISATION.search(t)) and m[1].lower() not in known]
    plain = [t for t, s in found if not s and 40 < len(t) < 300]
    out = []
    for i in range(n):
        if i % 2 and places:  # an organisation, mentioned again by its own name
            t, m = rnd.choice(places)
            w = invented(rnd, m[1])
            text, spans, again, kind = t.replace(m[1], w), [], w, ""
        else:
            t, s = rnd.choice(named)
            text, spans = changed(t, s, rnd)
            a, b, _ = rnd.choice([x for x in spans if x[2] == "name"])
            parts = re.findall(r"[^\W\d_]{3,}", text[a:b])
            again = rnd.choice([text[a:b], parts[-1] if parts else text[a:b], text[a:b].lower(), text[a:b].title()])
            kind = "name"
            if rnd.random() < 0.25 and len(again) > 5:  # one letter mistyped
                p = rnd.randrange(1, len(again) - 1)
                again = again[:p] + again[p + 1 :] if again[p - 1 : p + 2].isalpha() else again
        carrier = rnd.choice(plain)
        gaps = [m.start() for m in re.finditer(r"(?<=\w) (?=\w)", carrier)]
        p = rnd.choice(gaps) if gaps else len(carrier)
        start = len(text) + 1 + p + 1
        text = f"{text}\n{carrier[:p]} {again}{carrier[p:]}"
        out.append((text, spans + ([(start, start + len(again), kind)] if kind else [])))
    return out


def by_line(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, list]]:
    """The lines of a text with their items; every line is a chain."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((line, [(a - at, b - at, k) for a, b, k in spans if at <= a and b <= at + len(line)]))
        at += len(line) + 1
    return out


def mistyped(text: str, known: set[str], rnd: random.Random) -> str:
    """A copy with one or two common words mistyped: letters swapped, dropped or doubled."""
    words = [m for m in re.finditer(r"[^\W\d_]{5,}", text) if m.group().lower() in known]
    for m in sorted(rnd.sample(words, min(len(words), rnd.choice((1, 1, 2)))), key=lambda m: -m.start()):
        w, p = m.group(), rnd.randrange(1, len(m.group()) - 1)
        w = rnd.choice([w[:p] + w[p + 1] + w[p] + w[p + 2 :], w[:p] + w[p + 1 :], w[:p] + w[p] + w[p:]])
        text = text[: m.start()] + w + text[m.end() :]
    return text


def learn_skips(model: dict, docs: list[tuple[str, list]]) -> dict[str, dict[str, float]]:
    """Potentials of the skip edges: likelihood of the labels under loopy beliefs, all else fixed."""
    tagger = Tagger(model | {"skips": {s: dict.fromkeys(AGREEING, 0.0) for s in SKIPS}})
    u, text_of, place, first, size, word = tagger.unary([t for t, _ in docs])
    gold = [labelled(t, s)[1] for t, s in docs]
    y = np.array([gold[k][p] for k, p in zip(text_of.tolist(), place.tolist())])
    edges, kinds = tagger.edges(text_of, word)
    own = np.unique(np.searchsorted(first, edges.ravel(), side="right") - 1)
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first[own].tolist(), size[own].tolist())])
    starts, back = np.cumsum(size[own]) - size[own], np.searchsorted(rows, edges)
    part = u[rows].astype(np.float64)
    unit = {(s, k): agreement({x: {z: float(x == s and z == k) for z in AGREEING} for x in SKIPS})[SKIPS.index(s)] for s in SKIPS for k in AGREEING}
    ends = y[edges]
    w = {s: dict.fromkeys(AGREEING, 0.0) for s in SKIPS}
    square = Counter()
    for step in range(STEPS):
        _, both = crf.skip_messages(part, starts, size[own], back, kinds, agreement(w), tagger.trans, tagger.start)
        for (s, k), m in unit.items():
            at = kinds == SKIPS.index(s)
            g = float(m[ends[at, 0], ends[at, 1]].sum() - (both[at] * m).sum()) - w[s][k]
            square[s, k] += g * g
            w[s][k] += 0.6 * g / max(1e-9, square[s, k]) ** 0.5
    print(f"{len(edges)} skip edges, {int((kinds == 1).sum())} between like words; potentials {w}")
    return {s: {k: round(v, 3) for k, v in x.items()} for s, x in w.items()}


def fit(found: list, rnd: random.Random) -> dict:
    """The model of labelled texts."""
    some = [x for x in found if x[1]]
    wordings: dict[str, tuple] = {}
    for t, s in found:
        if not s:
            wordings.setdefault(wording(t, s), (t, s))
    plain = list(wordings.values())
    rnd.shuffle(plain)
    brief = [x for x in plain if len(x[0]) <= BRIEF][:MOST_PLAIN]  # headings look most like names
    plain = brief + [x for x in plain if len(x[0]) > BRIEF][:MOST_PLAIN]
    known = known_words(found)
    print(f"{len(some)} texts with items, {len(plain)} without, {len(known)} known words", flush=True)
    sample = some + plain
    copies = [changed(t, s, rnd) for t, s in some for _ in range(2)]
    copies += [(t.lower(), s) for t, s in rnd.sample(plain, len(plain) // 5) if len(t.lower()) == len(t)] + [(t.upper(), s) for t, s in rnd.sample(plain, len(plain) // 10) if len(t.upper()) == len(t)]
    copies += [x for t, s in with_mentions(found, known, rnd, MENTIONS) for x in by_line(t, s)[-1:]]
    copies += [(mistyped(t, known, rnd), []) for t, _ in rnd.choices(plain, k=2 * MENTIONS)]
    numbers: Counter = Counter()
    rows = []
    for t, s in (line for x in sample + copies for line in by_line(*x)):
        ts, ys = labelled(t, s)
        if ts:
            fs = features(t, ts, known)
            rows.append((fs, ys))
            numbers.update(x for p in fs for x in p)
    index = {"": 0}
    for x, n in numbers.items():
        if n >= 3:
            index[x] = len(index)
    data = []
    for fs, ys in rows:
        m = np.zeros((len(fs), max(map(len, fs))), dtype=np.int64)
        for i, p in enumerate(fs):
            m[i, : len(p)] = [index.get(x, 0) for x in p]
        data.append((m, np.array(ys)))
    w, trans, start = crf.train(data, len(index), len(LABELS))
    w -= w[:, :1]  # only differences to O count
    w[0] = 0
    model = {
        "known": sorted(known),
        "trans": np.round(trans, 2).tolist(),
        "start": np.round(start, 2).tolist(),
        "weights": {x: np.round(w[i], 2).tolist() for x, i in index.items() if x and np.abs(w[i]).max() > 0.05},
    }
    model["skips"] = learn_skips(model, with_mentions(found, known, rnd, MENTIONS))
    return model


def report(title: str, model: dict, texts: list, skips: bool = True) -> None:
    """Precision and recall of whole items by kind."""
    right, got, want = Counter(), Counter(), Counter()
    pred = Tagger(model, skips).spans([t for t, _ in texts])
    for (_, s), p in zip(texts, pred):
        want.update(k for _, _, k in s)
        got.update(k for _, _, k in p)
        right.update(k for _, _, k in set(p) & set(s))
    print(f"{title}, {len(texts)} texts: " + "; ".join(f"{k} precision {right[k] / max(1, got[k]):.3f} recall {right[k] / max(1, want[k]):.3f} of {want[k]}" for k in KINDS), flush=True)


def main(folder: str) -> None:
    qs = drawn(column(f"{folder}/query_history.parquet", "question"), MOST_ROWS)
    cs = drawn((p for c in column(f"{folder}/chunk.parquet", "text") if c for p in c.split("\n")), MOST_ROWS)
    texts = sorted({*qs, *cs})
    given, family, hg, hf = mined_names(texts)

    def pattern(gs: set[str], fs: set[str]) -> re.Pattern:
        alt = lambda s: "|".join(sorted(map(re.escape, s), key=len, reverse=True)) or "(?!)"
        g, f = alt(gs), alt(fs)
        return re.compile(rf"(?<!\w)(?:(?:{g})(?: [A-Z]\.)? (?:{f})|(?:{f}), (?:{g}))(?!\w)|(?<!\w)(?:{alt(hg)}) (?:{alt(hf)})(?!\w)", re.IGNORECASE)

    every = pattern(given, family)
    found = [(t, label(t, every, ORGANISATIONS)) for t in texts]
    held = lambda x: xxhash.xxh64_intdigest(x) % HELD == 0
    names = re.compile(r"(?<!\w)(?:" + "|".join(sorted((re.escape(x) for x in given | family if held(x)), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    by_name = [(t, s) for t, s in found if any(k == "name" and names.search(t[a:b]) for a, b, k in s)]
    own = {t for t, _ in by_name}
    by_wording = [(t, s) for t, s in found if t not in own and held(wording(t, s))]
    own |= {t for t, _ in by_wording}
    rnd = random.Random(11)
    first = fit([x for x in found if x[0] not in own], rnd)
    report("names held out", first, by_name)
    report("wordings held out", first, by_wording)
    again = with_mentions([x for x in found if x[0] in own], set(first["known"]), rnd, 600)
    report("mentioned again, held out", first, again)
    report("the same without skip edges", first, again, skips=False)
    model = fit(found, random.Random(11))
    MODEL.write_text(json.dumps(model, ensure_ascii=False, separators=(",", ":")))
    print(f"{len(model['weights'])} features, {MODEL.stat().st_size / 1e6:.2f} MB")
    report("all texts", model, found)


if __name__ == "__main__":
    main(sys.argv[1])
