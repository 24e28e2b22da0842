"""Noisy-channel restoration of disguised words.

A disguised token is a lattice: every written sign offers the letters it may
stand for (itself, look-alikes, any letter for a star, nothing for a separator,
one or two letters for a long run; eight or more stars any number of letters up to
their own).  The lattice is walked through a trie of the
lexicon, which gives every lexicon word it spells.  A character language model,
whose counts come from the whole corpus's words and the lexicon, scores these
words and, by a Viterbi pass over states of the last ``ORDER - 1`` letters, the
best of all paths; neither is pruned.  The final choice weighs the channel: plain
words are hardly ever disguised, so a lexicon word is accepted only if it scores
within ``CHANNEL`` of the best path.  The corpus's counts are scaled to the total
``MASS``, so the weight of a lexicon word is the same share at every size.

Every token with letters and a look-alike or star, at its edges too, a separator
inside or a run of one letter is decoded, in any script that the lexicon has; a star
stands for the letters of the token's own script.  Not read as disguises: stars around an emphasised stretch, a
possessive, a single letter beside digits only (a code or unit), and one or two
letters beside stars that are the likelier word by themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from lorikeet.llm.abuse_words import LEET

ORDER, CHANNEL = 4, 9.0
#: Total count of the corpus's words in the language model, and count of each lexicon word.
MASS, LEXICON_COUNT = 36_000.0, 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"

_CF = regex.compile(r"\p{Cf}+")
_OUT = r"\s,;:?\"“”()\[\]"
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: {1,2}[^\W\d_])+(?![^\W_])(?: {2,4}[^\W\d_](?: [^\W\d_])+(?![^\W_]))*")
#: Signs of Devanagari that belong to a letter.
_VOWELS = "\u0900-\u0903\u093a-\u094f"
_SIGNED = re.compile(rf"[^\s\w.,;:?\"“”()\[\]]?[\w{_VOWELS}@$*!#€+|]*[*@$#€|!][\w{_VOWELS}@$*!#€+|]+")
#: Words between two equal marks of emphasis; these stars hide nothing.
_EMPHASIS = re.compile(r"(?<![^\s(\[\"“])(\*{1,3})(?=[^\s*])([^\n]{0,2000}?[^\s*])\1(?![^\s.,;:!?)\]\"”])")
_EDGE = ".!'-"
_MARKS = "".join(re.escape(c) for c in LEET) + "*"
#: Tokens with a look-alike or star anywhere or a separator inside, and tokens with a long run.
_MARKED = re.compile(rf"(?<![^{_OUT}])[^{_OUT}{_MARKS}._\-·']*+(?:[{_MARKS}]|[._\-·']+(?=[^{_OUT}._\-·']))[^{_OUT}]*+")
_RUN, _ASCII_RUN = re.compile(rf"([^\W\d_]|[{_VOWELS}])\1\1"), re.compile(r"([a-z])\1\1")
_RUNS = re.compile(rf"(?<![^{_OUT}])[^{_OUT}]*?([^\W\d_]|[{_VOWELS}])\1\1[^{_OUT}]*+")
_LETTER = re.compile(r"[^\W\d_]")
#: One letter before or behind nothing but digits is a code or a unit (P19, 5g), not a word.
_CODE = re.compile(r"[\W_]*(?:[^\W\d_][\W\d_]*|[\W\d_]*[^\W\d_])[\W_]*")


def _devanagari(ch: str) -> bool:
    return "\u0900" <= ch <= "\u097f" and not ch.isnumeric()


def fold(text: str) -> str:
    """Compatibility form without format characters, lower-cased."""
    if not text.isascii():
        text = _CF.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def gram_counts(words: dict[str, int]) -> Counter:
    """Character n-gram counts of weighted words, all orders up to ``ORDER``."""
    c: Counter = Counter()
    for w, n in words.items():
        s = "^" * (ORDER - 1) + w + "$"
        for k in range(ORDER - 1, len(s)):
            for j in range(ORDER):
                c[s[k - j : k + 1]] += n
    return c


class Restorer:
    def __init__(self, grams: dict[str, int], lexicon: set[str]) -> None:
        self.lexicon = lexicon
        self.longest = max(map(len, lexicon), default=0)
        self.trie: dict = {}
        for w in lexicon:
            node = self.trie
            for ch in w:
                node = node.setdefault(ch, {})
            node["$"] = w
        scale = MASS / max(1, grams.get("$", 0))
        self.grams = Counter({g: n * scale for g, n in grams.items()})
        self.grams.update(gram_counts({w: LEXICON_COUNT for w in lexicon}))
        #: What a star may stand for, by the script of its token.
        signs = {ch for w in lexicon for ch in w}
        self.letters = {
            "ascii": tuple(LETTERS),
            "latin": tuple(sorted({*LETTERS, *(ch for ch in signs if ch.isalpha() and ch < "\u0250")})),
            "devanagari": tuple(sorted(ch for ch in signs if _devanagari(ch))),
        }
        self.total = Counter()
        for g, n in self.grams.items():
            self.total[g[:-1]] += n
        # The same counts by order, as codes of letters, for the tensors of ``_model``.
        self.code = {ch: k for k, ch in enumerate(sorted({ch for g in self.grams for ch in g}))}
        self.by_order = []
        for size in range(1, ORDER + 1):
            gs = [g for g in self.grams if len(g) == size]
            codes = np.array([[self.code[ch] for ch in g] for g in gs], dtype=np.int64).reshape(-1, size)
            self.by_order.append((codes, np.array([self.grams[g] for g in gs]), np.array([self.total[g[:-1]] for g in gs])))
        self.models: dict[str, np.ndarray] = {}
        self.cache: dict[str, str | None] = {}

    def _logp(self, context: str, ch: str) -> float:
        """Interpolated back-off over the shorter contexts."""
        p = 1.0 / 40
        for j in range(ORDER):
            ctx = context[len(context) - j :] if j else ""
            n = self.total.get(ctx, 0)
            if j and not n:
                break
            p = (self.grams.get(ctx + ch, 0) + 2.0 * p) / (n + 2.0)
        return math.log(p)

    def steps(self, token: str) -> Iterator[tuple[str, ...]]:
        """The alternatives at one position of a disguised token after the other."""
        letters = self.letters["ascii" if token.isascii() else "devanagari" if any(map(_devanagari, token)) else "latin"]
        i, n = 0, len(token)
        while i < n:
            ch, j = token[i], i
            while j < n and token[j] == ch:
                j += 1
            run = j - i
            if ch == "*":
                # No lexicon word has more letters than the longest.
                yield from [letters] * run if run < 8 else [(*letters, "")] * min(run, self.longest)
            elif ch in " ._-·'":
                yield ("",)
            elif ch in LEET:
                yield from [tuple(LEET[ch]) + (() if ch.isdigit() or ch not in "!+|#" else ("",))] * min(run, 2)
            elif ch.isalpha() or _devanagari(ch):
                yield (ch, ch * 2) if run > 2 else (ch * run,)
            else:
                yield ("",)
            i = j

    def lattice(self, token: str) -> list[tuple[str, ...]]:
        return list(self.steps(token))

    def decode(self, token: str) -> str | None:
        """The lexicon word that a disguised token stands for, or None."""
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) > 100_000:
            self.cache.clear()
        word = self._decode(token)
        if len(token) < 100:
            self.cache[token] = word
        return word

    def _spelled(self, steps: Iterable[tuple[str, ...]]) -> set[str]:
        """Every lexicon word among the paths of a lattice."""
        nodes = {id(self.trie): self.trie}
        for alts in steps:
            nxt = {}
            for node in nodes.values():
                for a in alts:
                    to = node
                    for ch in a:
                        to = to.get(ch) if to is not None else None
                    if to is not None:
                        nxt[id(to)] = to
            if not nxt:
                return set()
            nodes = nxt
        return {node["$"] for node in nodes.values() if "$" in node}

    def _model(self, letters: str) -> np.ndarray:
        """``_logp`` of every letter, and of the end, behind every context of ``letters``."""
        if letters in self.models:
            return self.models[letters]
        signs = "^" + letters + "$"
        n = len(signs)
        local = np.full(len(self.code) + 1, -1)
        for k, ch in enumerate(signs):
            local[self.code.get(ch, len(self.code))] = k
        local[-1] = -1
        p = np.full((1,) * (ORDER - 1) + (n,), 1.0 / 40)
        for size, (codes, count, totals) in enumerate(self.by_order, 1):
            at = local[codes]
            ok = (at >= 0).all(axis=1)
            own = np.zeros((n,) * size)
            own[tuple(at[ok].T)] = count[ok]
            total = np.zeros((n,) * (size - 1))
            if size == 1:
                total[()] = self.total.get("", 0)
            else:
                at = local[codes[:, :-1]]
                ok = (at >= 0).all(axis=1)
                total[tuple(at[ok].T)] = totals[ok]
            p = (own.reshape((1,) * (ORDER - size) + own.shape) + 2.0 * p) / (total[..., None].reshape((1,) * (ORDER - size) + total.shape + (1,)) + 2.0)
        p = np.log(np.broadcast_to(p, (n,) * ORDER))
        if len(self.models) > 8:
            self.models.clear()
        self.models[letters] = p
        return p

    def _best(self, steps: list[tuple[str, ...]]) -> float:
        """The highest score of any path of a lattice: exact, one state per last three letters."""
        letters = "".join(sorted({ch for alts in steps for a in alts for ch in a}))
        model = self._model(letters)
        at = {ch: k for k, ch in enumerate(letters, 1)}
        n = len(letters) + 2
        state = np.full((n,) * (ORDER - 1), -np.inf)
        state[(0,) * (ORDER - 1)] = 0.0

        def write(s: np.ndarray, ks: list[int]) -> np.ndarray:
            out = np.full_like(s, -np.inf)
            out[..., ks] = (s[..., None] + model[..., ks]).max(axis=0)
            return out

        for alts in steps:
            nxt = state if "" in alts else np.full_like(state, -np.inf)
            if ones := [at[a] for a in alts if len(a) == 1]:
                nxt = np.maximum(nxt, write(state, ones))
            for a in alts:
                if len(a) > 1:
                    s = state
                    for ch in a:
                        s = write(s, [at[ch]])
                    nxt = np.maximum(nxt, s)
            state = nxt
        return float((state + model[..., n - 1]).max())

    def score(self, word: str) -> float:
        s = "^" * (ORDER - 1) + word + "$"
        return sum(self._logp(s[k - ORDER + 1 : k], s[k]) for k in range(ORDER - 1, len(s)))

    def _decode(self, token: str) -> str | None:
        words = self._spelled(self.steps(token))
        if not words:
            return None
        steps = self.lattice(token)
        p, word = max((self.score(w), w) for w in words)
        # Two letters beside stars may as well be a short plain word with a footnote.
        plain = token.strip("*")
        if plain != token and len(plain) < 3 and plain.isalpha() and self.score(plain) > p:
            return None
        return word if p >= self._best(steps) - CHANNEL else None

    def restore(self, text: str) -> str:
        """A folded text with its disguised lexicon words written out."""
        def spaced(m: re.Match) -> str:
            words = [w.replace(" ", "") for w in re.split(r" {2,}", m.group())]
            found = [self.decode(w) or (w if w in self.lexicon else None) for w in words]
            return " ".join(f or w for f, w in zip(found, words)) if any(found) else m.group()

        if "  " in text or " " in text:
            text = _SPACED.sub(spaced, text)
        if text.count("*") > 1:
            text = _EMPHASIS.sub(self._plain, text)
        if any(c in text for c in "*@$#€|!"):
            text = _SIGNED.sub(lambda m: self.decode(m.group()) or m.group(), text)
        text = _MARKED.sub(self._written, text)
        return _RUNS.sub(self._written, text) if (_ASCII_RUN if text.isascii() else _RUN).search(text) else text

    def _plain(self, m: re.Match) -> str:
        """An emphasised stretch without its marks, unless both ends are disguised words."""
        words = m.group().split()
        disguised = len(words) > 1 and self.decode(words[0]) and self.decode(words[-1])
        return m.group() if disguised else m.group(2)

    def _written(self, m: re.Match) -> str:
        """A marked token with its word written out; signs at its edges may belong to it or not."""
        token = m.group()
        core = token.strip(_EDGE)
        if core.isdigit() or not _LETTER.search(core):
            return token
        if any(c.isdigit() for c in core) and _CODE.fullmatch(core) or core.endswith("'s") and core[:-2].isalpha():
            return token  # a code, or a possessive
        at = token.index(core)
        before, behind = token[:at], token[at + len(core) :]
        if core in self.lexicon:
            return token
        for left, word, right in ((before, core, behind), ("", before + core, behind), (before, core + behind, ""), ("", token, "")):
            if found := self.decode(word):
                return left + found + right
        return token
