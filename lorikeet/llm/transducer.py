"""A minimal acyclic transducer: words in, word numbers out, in flat arrays.

States that accept the same suffixes with the same outputs are one state.  Each
arc carries a number; the sum along a word's path is its rank among all words
in byte order, which indexes a table of id lists.  All arrays lie in
one flat file that readers memory-map.
"""

from __future__ import annotations

import io

import numpy as np

_MAGIC = np.int64(0x4C4F5249)
_FIELDS = ("keys", "target", "out", "final", "id_off", "ids")


def build(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The transducer of distinct ``words``; ``ids[k]`` is the output of ``words[k]``."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    arcs_of: list[list[tuple[int, int]]] = []  # per state: (label, target)
    final: list[bool] = []

    def freeze(node: list) -> int:
        key = (node[1], tuple(node[0]))
        if (s := register.get(key)) is None:
            s = register[key] = len(arcs_of)
            arcs_of.append(list(node[0]))
            final.append(node[1])
        return s

    path: list[list] = [[[], False]]  # nodes of the current word: [arcs, final]
    last = b""
    for k in order:
        w = words[k]
        common = 0
        top = min(len(w), len(last))
        while common < top and w[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            s = freeze(path.pop())
            path[-1][0].append((last[depth - 1], s))
        path.extend([[], False] for _ in range(len(w) - common))
        path[-1][1] = True
        last = w
    for depth in range(len(last), 0, -1):
        s = freeze(path.pop())
        path[-1][0].append((last[depth - 1], s))
    root = freeze(path.pop())

    count = [0] * len(arcs_of)  # words accepted from each state; targets come first
    keys, target, out = [], [], []
    for s, arcs in enumerate(arcs_of):
        n = int(final[s])
        for label, t in arcs:
            keys.append(s * 256 + label)
            target.append(t)
            out.append(n)
            n += count[t]
        count[s] = n
    lists = [ids[k] for k in order]
    fields = {
        "keys": np.array(keys, dtype=np.int64),
        "target": np.array(target, dtype=np.int64),
        "out": np.array(out, dtype=np.int64),
        "final": np.array(final, dtype=np.int64),
        "id_off": np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64),
        "ids": np.array([i for x in lists for i in x], dtype=np.int64),
    }
    buf = io.BytesIO()
    buf.write(np.array([_MAGIC, root, *(len(fields[f]) for f in _FIELDS)], dtype=np.int64).tobytes())
    for f in _FIELDS:
        buf.write(fields[f].tobytes())
    return buf.getvalue()


class Transducer:
    """Reader over the memory-mapped file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.int64, mode="r")
        if data[0] != _MAGIC:
            raise ValueError(f"{path} is no transducer file")
        self.root, at = int(data[1]), 2 + len(_FIELDS)
        for f, n in zip(_FIELDS, data[2:at].tolist()):
            setattr(self, f, data[at : at + n])
            at += n

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1, all words walking the automaton together."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(words) else np.empty(0, dtype=np.int64)
        state = np.full(len(words), self.root, dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        live = np.arange(len(words)) if len(self.keys) else np.empty(0, dtype=np.int64)
        dead = np.zeros(len(words), dtype=bool) if len(self.keys) else size > 0
        depth = 0
        while len(live := live[size[live] > depth]):
            key = state[live] * 256 + blob[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            dead[live[~hit]] = True
            live, at = live[hit], at[hit]
            number[live] += self.out[at]
            state[live] = self.target[at]
            depth += 1
        ok = ~dead & (self.final[state] == 1)
        return np.where(ok, number, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.id_off[number] : self.id_off[number + 1]].tolist()
