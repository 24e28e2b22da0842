"""Literals that every match of a regular expression contains.

An automaton over them finds the texts worth a regular expression in one scan,
and loses none.
"""

from __future__ import annotations

from collections.abc import Iterable
from re import _parser as sre

import ahocorasick


#: Words that most texts hold; a choice with one of them is the last to be taken.
FREQUENT = frozenset(["you", "your", "will", "should", "must", "ought to", "going to", "are", "is", "the", "just", "please", "out of"])


def required(pattern: str) -> frozenset[str]:
    """Literals of which every match of a pattern contains one: of the choices that its parts
    offer, the one whose shortest literal is longest, frequent words aside."""

    def of(items: Iterable) -> frozenset[str]:
        choices, run = [], ""
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if op is sre.AT:  # a boundary has no width
                continue
            choices.append(frozenset([run.strip()]))
            run = ""
            if op is sre.SUBPATTERN:
                choices.append(of(arg[-1]))
            elif op is sre.BRANCH:
                choices.append(frozenset().union(*map(of, arg[1])))
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                choices.append(of(arg[2]))
        choices.append(frozenset([run.strip()]))
        return max(choices, key=lambda ws: min(len(w) if w not in FREQUENT else min(len(w), 1) for w in ws))

    return of(sre.parse(pattern))


class Gate:
    """Whether a lower-cased text holds a literal that one of the patterns requires."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.machine = ahocorasick.Automaton()
        self.open = False
        for p in patterns:
            for w in required(p):
                if w:
                    self.machine.add_word(w.lower(), True)
                else:
                    self.open = True  # a pattern without a literal may match anywhere
        self.machine.make_automaton()

    def __call__(self, low: str) -> bool:
        return self.open or next(self.machine.iter(low), None) is not None
