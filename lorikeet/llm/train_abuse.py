"""Fits the weights of the abuse score: ``python -m lorikeet.llm.train_abuse TABLE_DIR [OTHER_DIR...]``.

The evidence of a sentence (``abuse.evidence``) is weighed by a logistic regression
fitted to the reviewers' labels.  A document counts by its sentence of highest
score, so sentences and weights are found in turns.  Labels are few and some are
wrong, so every weight has a prior: kinds of evidence that no labelled document
shows keep it.  Two thirds of the labelled documents, by the hash of their text (so
that copies stay together), are fitted; the third held out, and the labels of other
tables, are scored and printed.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow.dataset as ds
import xxhash

from lorikeet.llm.abuse import EVIDENCE, MODEL, PRIOR, Scorer, counted_words
from lorikeet.llm.deobfuscate import gram_counts

#: Most labelled rows that are fitted (drawn by the hash of their id), spread of the weights
#: around their prior, rounds of choosing sentences and fitting.
MOST_LABELS, SPREAD, ROUNDS = 5000, 1.0, 5


def labelled(folder: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """Texts with a label (each label counts), and all texts."""
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(["doc_id", "text"])
    text = dict(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()))
    rows = ds.dataset(f"{folder}/review_labels.parquet").to_table(["doc_id", "label"]).to_pylist()
    rows = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"])))[:MOST_LABELS]
    return [(text[r["doc_id"]], r["label"] == "unsafe") for r in rows if text.get(r["doc_id"])], [t for t in text.values() if t]


def scorer(texts: list[str], weights: dict[str, float]) -> Scorer:
    return Scorer(gram_counts({w: round(64 * n**0.5) for w, n in counted_words(texts).items() if n > 1}), weights)


def fit(docs: list[tuple[np.ndarray, bool]], prior: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of documents given by the evidence of their sentences."""
    w = prior.copy()
    y = np.array([float(label) for _, label in docs])
    for _ in range(ROUNDS):
        x = np.stack([np.append(s[(s @ w[:-1]).argmax()] if len(s) else np.zeros(len(w) - 1), 1.0) for s, _ in docs])
        for _ in range(30):  # Newton steps
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (y - p) - (w - prior) / SPREAD**2
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2
            w = w + np.linalg.solve(hess, grad)
    return w


def report(title: str, found: list[tuple[bool, bool]]) -> None:
    true, got = sum(y for y, _ in found), sum(p for _, p in found)
    both = sum(y and p for y, p in found)
    print(f"{title}: {len(found)} labels, {true} unsafe; recall {both / max(1, true):.3f}, precision {both / max(1, got):.3f}")


def main(folder: str, others: list[str]) -> None:
    docs, texts = labelled(folder)
    s = scorer(texts, PRIOR)
    seen = [(t, np.array([[e[k] for k in EVIDENCE] for e, _ in s.sentences(t)], dtype=np.float64).reshape(-1, len(EVIDENCE)), y) for t, y in docs]
    held = [xxhash.xxh64_intdigest(t) % 3 == 0 for t, _, _ in seen]
    prior = np.array([*(PRIOR[k] for k in EVIDENCE), PRIOR["bias"]])
    w = fit([(x, y) for (_, x, y), h in zip(seen, held) if not h], prior)
    weights = {k: round(float(v), 3) for k, v in zip((*EVIDENCE, "bias"), w)}
    MODEL.write_text(json.dumps(weights, indent=1) + "\n")
    print(weights)
    for title, part in (("fitted", False), ("held out", True)):
        report(title, [(y, bool(len(x)) and bool((x @ w[:-1]).max() + w[-1] >= 0)) for (_, x, y), h in zip(seen, held) if h is part])
    for d in others:
        docs, texts = labelled(d)
        s = scorer(texts, weights)
        report(d, [(y, bool(s.passages(t)) and max(s.passages(t))[0] >= 0.5) for t, y in docs])


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
