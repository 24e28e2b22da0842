"""The text operators against brute force, exact round trips and held-out forms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORDS = "claim cover the policy is paid when a member sends this form to our desk within ten days and never later than that under rule six".split()


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randrange(9)) if rnd.random() < 0.2 else "") for _ in range(n))


# ---- 2: repeated lines


def lines_brute(rows, least):
    docs, occ = defaultdict(set), []
    for d, s, t in set(rows):
        if None in (d, s, t):
            continue
        for k, line in enumerate(t.split("\n")):
            key = "".join(c for c in line if c.isalpha()).lower()
            if len(key) >= 4:
                docs[s, key].add(d)
                occ.append((d, k, s, key))
    return {(d, k) for d, k, s, key in occ if len(docs[s, key]) >= least}


def test_repeated_lines(spark):
    from lorikeet.llm.repeated_lines import excessive_nodes, mark, occurrences, without_lines

    rnd = random.Random(1)
    rows = []
    for k in range(80):
        s = "hot" if k % 2 else f"s{k % 5}"
        foot = f"--- Page {k} of 90 ---" if k % 3 else f"PAGE {k} OF 7"
        rows.append((f"c{k}", s, "\n".join([text_of(rnd, 9), foot, text_of(rnd, 5), f"Printed for {rnd.choice(['Anna', 'Bert'])} Xu on 0{k % 9} May", "ab", ""])))
    rows += rows[:10] + [("n", None, "x\ny"), ("m", "hot", None), ("e", "hot", ""), (None, "hot", "Page 1 of 2")]
    df = spark.createDataFrame(rows, "doc string, source string, text string").withColumns({"line": F.lit(1), "h": F.lit("x"), "mask": F.lit(2)})
    occ = occurrences(df, "doc", "source", "text")
    nodes = excessive_nodes(occ, 10)
    got = {(r.doc, r.line_no) for r in mark(occ, nodes.where("class_docs >= 10")).collect()}
    assert got == lines_brute(rows, 10) and got
    clean = {r.doc: (r.text, r.n_removed) for r in without_lines(df, "doc", "text", mark(occ, nodes)).collect()}
    # names differ, so the letters differ too: only the near-duplicate clusters take these lines out
    assert all("Printed" not in clean[f"c{k}"][0] for k in range(1, 80, 2))
    assert clean["e"] == ("", 0) and clean["m"] == (None, 0) and clean["n"] == ("x\ny", 0)
    empty = occurrences(df.limit(0), "doc", "source", "text")
    assert mark(empty, excessive_nodes(empty)).count() == 0


def test_clusters_decide_repeated_lines(spark, monkeypatch):
    """Without the bands every written line stands alone, and no page number repeats often enough."""
    from lorikeet.llm import repeated_lines as R

    rows = [(f"c{k}", "s", f"--- Page {k} of 90 ---\n{k} pages, page of {k}") for k in range(30)]
    occ = R.occurrences(spark.createDataFrame(rows, "doc string, source string, text string"), "doc", "source", "text")
    assert R.mark(occ, R.excessive_nodes(occ, 10).where("class_docs >= 10")).count() == 60
    monkeypatch.setattr(R, "clusters", lambda occ, similarity: occ.groupBy("h").agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("h")).withColumn("cluster", F.col("class")))
    assert R.excessive_nodes(occ, 10).count() == 0


def test_masks():
    from lorikeet.llm.repeated_lines import masked

    assert masked("Printed for Anna Maria Xu on 03 May 2024, page 3/90") == ["printed", "for", "1", "on", "0", "may", "0", "page", "0"]
    assert masked("Die Person reicht die Rechnung ein") == "die person reicht die rechnung ein".split()
    assert masked("") == [] and masked("--- 12 ---") == ["0"]


def test_near_duplicate_lines_meet(spark):
    """Every pair of lines alike at 0.8 or more ends in one cluster, a hot bucket included."""
    from lorikeet.llm.repeated_lines import SHINGLE, clusters, masked, occurrences

    rnd = random.Random(4)
    base = [text_of(rnd, 30) for _ in range(6)]
    lines = []
    for k in range(240):
        ws = base[k % 6].split()
        if k % 4:
            ws[rnd.choice([0, len(ws) - 1])] = rnd.choice(WORDS) + rnd.choice("xyz")
        lines.append(" ".join(ws))
    occ = occurrences(spark.createDataFrame([(f"d{k}", "s", t) for k, t in enumerate(lines)], "doc string, source string, text string"), "doc", "source", "text")
    c = {r.h: r.cluster for r in clusters(occ).collect()}
    of = {r.line: c[r.h] for r in occ.select("line", "h").collect()}
    sets = {t: {tuple(masked(t)[i : i + SHINGLE]) for i in range(max(1, len(masked(t)) - SHINGLE + 1))} for t in of}
    alike = [(a, b) for a in of for b in of if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 500 and sum(of[a] == of[b] for a, b in alike) >= 0.99 * len(alike)


def test_no_link_at_the_threshold_is_lost(spark):
    """2000 pairs of lines alike at exactly 0.8, and lines in a row where each is like the next alone."""
    from lorikeet.llm.repeated_lines import clusters, occurrences

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    lines, like = [], []
    for _ in range(2000):
        ws = [word() for _ in range(13)]
        lines += [" ".join(ws), " ".join([*ws[:12], word()])]
        like.append((len(lines) - 2, len(lines) - 1))
    row = [word() for _ in range(160)]
    for k in range(148):
        lines.append(" ".join(row[k : k + 13]))
        like += [(len(lines) - 2, len(lines) - 1)] * (k > 0)
    rows = [(f"d{k}", "s", t) for k, t in enumerate(lines)] + [(f"o{k}", "other", t) for k, t in enumerate(lines[:40:2])]
    occ = occurrences(spark.createDataFrame(rows, "doc string, source string, text string"), "doc", "source", "text")
    c = {r.h: r.cluster for r in clusters(occ).collect()}
    of = {r.doc: c[r.h] for r in occ.select("doc", "h").collect()}
    assert all(of[f"d{a}"] == of[f"d{b}"] for a, b in like)
    assert len(set(of.values())) == 2001 + 20  # a source links with itself only


# ---- 3: near-duplicate records


def shingles(t, k):
    ws = re.findall(r"[^\W_]+", t.lower())
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize("k,threshold,cell,sent,counters", [(3, 0.6, 4096, 100, 1 << 20), (3, 0.6, 8, 0, 64), (3, 0.6, 8, 100_000, 1 << 20), (5, 0.8, 4096, 100, 1)])
def test_near_records(spark, monkeypatch, k, threshold, cell, sent, counters):
    """Against all pairs, also with blocks of lists and with an order that hardly knows a length."""
    from lorikeet.llm import near_records as N

    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "MOST_SENT", sent)
    monkeypatch.setattr(N, "COUNTERS", counters)
    rnd = random.Random(2)
    base = [text_of(rnd, 60) for _ in range(12)]
    rows = []
    for i in range(150):
        ws = base[i % 12].split() if i % 3 else text_of(rnd, 50).split()
        for _ in range(rnd.randrange(5)):
            p = rnd.randrange(len(ws))
            ws[p : p + rnd.randrange(2)] = [rnd.choice(WORDS) + "x"]
        rows.append((f"r{i:03}", " ".join(ws)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("short", "one two"), ("e", ""), ("n", None), (None, rows[0][1]), rows[3]]
    for j in range(4):
        ws = [rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(900)]
        rows.append((f"long{j}", " ".join(ws)))
        rows.append((f"long{j}x", " ".join(w if rnd.random() > 0.02 * j else "new" for w in ws)))
    df = spark.createDataFrame(rows, "key string, text string").withColumns({"sid": F.lit(1), "set": F.lit("x"), "n": F.lit(0)})
    members, links = N.near_records(df, "key", "text", k, threshold, 10)
    own = {a: shingles(t, k) for a, t in rows if a and t and len(re.findall(r"[^\W_]+", t)) >= 10}
    want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold - 1e-9}
    got = [tuple(r) for r in N.expand(members, links).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    groups = {r.key: (r.group_key, r.n_links) for r in N.groups(members, links).collect()}
    assert set(groups) == set(own)
    degree = Counter(x for p in want for x in p)
    assert all(groups[a][1] == degree[a] for a in own)
    assert all(groups[a][0] == groups[b][0] for a, b in want)
    assert N.expand(*N.near_records(df.limit(0), "key", "text")).count() == 0


@pytest.mark.parametrize("at,formed", [(28, 300 * 299 // 2), (29, 0), (40, 0)])
def test_lists_long_for_a_pair_form_no_pairs(at, formed):
    """Sets of 100 must share 75 at 0.6 and 4 in short lists: from the 30th list on, nothing meets."""
    import numpy as np
    import pyarrow as pa

    from lorikeet.llm import near_records as N

    n, zero = 300, np.zeros((300, N.LANES), dtype=np.int64)
    same = lambda x, kind: pa.array(np.full(n, x), kind)
    cell = {"t": same(7, pa.int64()), "i": same(0, pa.int32()), "j": same(0, pa.int32()), "n": same(100, pa.int32()), "left": same(100 - at, pa.int32()), "sid": pa.array(np.arange(n)), "block": same(0, pa.int32()), "sketch": N._pack(zero, zero, np.zeros(n, dtype=bool))}
    assert sum(b.num_rows for b in N._meet(0.6)(iter([pa.RecordBatch.from_pydict(cell)]))) == formed


def test_components(spark):
    from lorikeet.llm.components import components

    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


# ---- 4: personal items


def test_items():
    from lorikeet.llm.pii import Tagger, redact

    cases = [
        ("My name is Dorvala Quistrune, is hernia repair covered after 20 days?", [("name", "Dorvala Quistrune")]),
        ("Call me on +1 (555) 010-2345 about angioplasty under claim CLM-123456?", [("phone", "+1 (555) 010-2345")]),
        ("contact: tilda.x at home dot test / five five five one two three four five six seven", [("email", "tilda.x at home dot test"), ("phone", "five five five one two three four five six seven")]),
        ("Passport QX 11 22 33 Z, treated abroad for angioplasty, do I need the consent note?", [("id_number", "QX 11 22 33 Z")]),
        ("Update my address to Flat 3B, 12 Juniper Lane, Silverfen - 12345 and tell me whether restoration still applies?", [("address", "Flat 3B, 12 Juniper Lane, Silverfen - 12345")]),
        ("Receipt TR-15358024 from Larkendale Eye Clinic reached the claims desk on 2022-03-19 under tariff code 593-1101.", []),
        ("", []),
        ("\n \n", []),
        ("x" * 100_000, []),
    ]
    tagger = Tagger()
    found = tagger.spans([t for t, _ in cases])
    for (t, want), spans in zip(cases, found):
        assert [(k, t[a:b]) for a, b, k in spans] == want
    assert redact(cases[1][0], found[1]) == "Call me on [PHONE] about angioplasty under claim CLM-123456?"
    assert tagger.spans([]) == [] and tagger.spans([None]) == [[]]
    # items don't depend on what else is in the batch
    assert [tagger.spans([t])[0] for t, _ in cases] == found


def test_skip_messages_let_repeats_agree():
    import numpy as np

    from lorikeet.llm.crf import skip_messages, viterbi_lines

    trans, start = np.zeros((2, 2)), np.zeros(2)
    u = np.array([[0.0, 4.0], [0.3, 0.0]])  # a sure position and an unsure one, in lines of their own
    first, size = np.array([0, 1]), np.array([1, 1])
    assert viterbi_lines(u, first, size, trans, start).tolist() == [1, 0]
    agree = np.array([[[0.0, 0.0], [0.0, 2.0]]])
    v, both = skip_messages(u, first, size, np.array([[0, 1]]), np.array([0]), agree, trans, start)
    assert viterbi_lines(v, first, size, trans, start).tolist() == [1, 1]
    # two nodes form a tree, so the beliefs are exact
    p = np.exp(u[0][:, None] + u[1][None, :] + agree[0])
    assert np.allclose(both[0], p / p.sum())


def test_lines_in_step_are_the_single_lines():
    import numpy as np

    from lorikeet.llm.crf import forward_backward, marginals, viterbi, viterbi_lines

    rng = np.random.default_rng(1)
    size = np.array([3, 1, 7, 0, 7, 2])[[0, 1, 2, 4, 5]]
    first = np.cumsum(size) - size
    u, trans, start = rng.normal(size=(size.sum(), 4)), 3 * rng.normal(size=(4, 4)), rng.normal(size=4)
    y, m = viterbi_lines(u, first, size, trans, start), marginals(u, first, size, trans, start)
    for a, n in zip(first, size):
        f, g, z = forward_backward(u[a : a + n], trans, start)
        assert y[a : a + n].tolist() == viterbi(u[a : a + n], trans, start).tolist() and np.allclose(m[a : a + n], f + g - z)
    none = np.zeros(0, dtype=np.int64)
    assert len(viterbi_lines(u[:0], none, none, trans, start)) == 0


def test_skip_edges_decide():
    """Names of two invented parts, and the family name again at a neutral place: many mentions
    are only found with the edges, over any distance, and none is lost by them."""
    from lorikeet.llm.pii import Tagger

    rnd = random.Random(8)
    part = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).capitalize() + rnd.choice(["n", "r", "th", "lis"])
    gap = "the claims desk compared the hospital bill with the policy schedule. " * 30
    texts, again = [], []
    for k in range(120):
        a, b = part(), part()
        t = f"My name is {a} {b}, is hernia repair covered?\n{gap if k % 2 else ''}\nWho compared the note of the {b.lower() if k % 3 == 0 else b} bill?"
        texts.append(t)
        again.append(t.rindex(b.lower() if k % 3 == 0 else b))
    found = lambda skips: {k for k, (spans, p) in enumerate(zip(Tagger(skips=skips).spans(texts), again)) if any(x <= p < y and kind == "name" for x, y, kind in spans)}
    on, off = found(True), found(False)
    assert off <= on and len(on) >= 70 and len(on) >= len(off) + 50
    assert {k % 2 for k in on - off} == {0, 1}


def test_lines_left_undecoded_are_all_outside(sf):
    """The bound that spares the decoding of a line is exact."""
    import numpy as np
    import pyarrow.parquet as pq

    from lorikeet.llm.crf import viterbi_lines
    from lorikeet.llm.pii import Tagger

    t = Tagger(skips=False)
    rng = np.random.default_rng(3)
    for lo, noise in ((0, 0.0), (40, 1.5)):
        u, text_of, _, first, size, word = t.unary(pq.read_table(f"{sf}/chunk.parquet").column("text").to_pylist()[lo : lo + 40])
        u = u + noise * rng.normal(size=u.shape)
        y = t.labels(u, text_of, first, size, word)
        assert y.tolist() == viterbi_lines(u, first, size, t.trans, t.start).tolist() and (noise == 0 or y.any())


def test_names_end_at_their_parts():
    from lorikeet.llm.pii import whole_name

    t = ". Tilda K. Wren, 12"
    assert whole_name(t, 0, 16, "name") == (2, 15, "name") and whole_name(t, 0, 19, "name") is None and whole_name(t, 0, 2, "name") is None
    assert whole_name("रवि शर्मा", 0, 9, "name") == (0, 9, "name")


def test_edges_join_same_and_like_words():
    from lorikeet.llm.pii import Tagger, shortened

    t = Tagger()
    texts = ["Zorvanne met ZORVANNE.\nzorvane and Zorvanne", "Zorvanne", "claim claim"]
    _, text_of, _, _, _, word = t.unary(texts)
    edges, kinds = t.edges(text_of, word)
    assert sorted(kinds.tolist()) == [0, 0, 1] and all(text_of[a] == text_of[b] == 0 for a, b in edges)
    assert set(shortened("abc")) == {"abc", "bc", "ac", "ab"}


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    from lorikeet.llm.crf import forward_backward, viterbi

    rng = np.random.default_rng(0)
    u, trans, start = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    paths = list(itertools.product(range(3), repeat=5))
    score = np.array([start[p[0]] + sum(u[t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
    a, b, z = forward_backward(u, trans, start)
    assert np.isclose(z, np.log(np.exp(score).sum()))
    w = np.exp(score - z)
    assert np.allclose(np.exp(a + b - z)[2], [w[[p[2] == y for p in paths]].sum() for y in range(3)])
    assert tuple(viterbi(u, trans, start)) == paths[int(score.argmax())]


def test_item_table(spark):
    from lorikeet.llm.pii import find_items, redact_texts

    df = spark.createDataFrame([(1, "reach me at a.b@home.test"), (1, "reach me at a.b@home.test"), (2, None), (None, "x@home.test"), (3, "")], "key long, text string").withColumn("kind", F.lit("clash"))
    got = find_items(df, "key", "text").distinct().collect()
    assert [(r.key, r.kind, r.start_pos, r.end_pos) for r in got] == [(1, "email", 12, 25)]
    assert {(r.key, r.text, r.n_items) for r in redact_texts(df, "key", "text").collect()} == {(1, "reach me at [EMAIL]", 1), (2, None, 0), (3, "", 0)}
    assert find_items(df.limit(0), "key", "text").count() == 0


# ---- 5: splitting


def greedy(n, bounds, limit, overlap):
    ends, start = [], 0
    while not ends or ends[-1] < n:
        if start + limit >= n:
            ends.append(n)
            break
        last = ends[-1] if ends else 0
        legal = [b for b in bounds if last < b <= start + limit]
        ends.append(legal[-1] if legal else start + limit)
        start = ends[-1] - overlap
    return ends


def test_greedy_cuts():
    import numpy as np

    from lorikeet.llm.split import greedy_cuts

    rnd = random.Random(3)
    sizes = [rnd.randrange(51, 900) for _ in range(200)]
    bounds = [sorted(rnd.sample(range(1, n), min(n - 1, rnd.choice((0, 1, 3, 30, 200))))) for n in sizes]
    got = greedy_cuts([np.array(b, dtype=np.int64) for b in bounds], sizes, 50, 8)
    for n, b, ends in zip(sizes, bounds, got):
        assert ends.tolist() == greedy(n, b, 50, 8)


def test_split_table(spark):
    from lorikeet.llm.split import split_oversized

    rnd = random.Random(5)
    long = ". ".join(text_of(rnd, 20).capitalize() for _ in range(60))
    unbroken = " ".join(["w"] * 1300)
    df = spark.createDataFrame([("a", long, "H"), ("a", long, "H"), ("b", "short", None), ("c", unbroken, None), ("n", None, None), (None, long, None), ("e", "", None), ("x", " ".join(["w"] * 512), None)], "key string, text string, heading string").withColumn("piece_no", F.lit("clash"))
    out = defaultdict(list)
    for r in split_oversized(df, "key", "text", "heading").collect():
        out[r.key].append(r)
    assert set(out) == {"a", "c"}
    for key, text in (("a", long), ("c", unbroken)):
        ps = sorted(out[key], key=lambda r: r.piece_no)
        ws = text.split()
        assert [r.piece_no for r in ps] == list(range(len(ps))) and ps[0].start_word == 0 and ps[-1].end_word == len(ws)
        for p, q in zip(ps, ps[1:]):
            assert q.start_word == p.end_word - 77
        for p in ps:
            assert p.piece.split() == ws[p.start_word : p.end_word] and len(p.piece.split()) <= 512
    assert all(r.natural_end and r.heading == "H" for r in out["a"])
    assert split_oversized(df.limit(0), "key", "text", "heading").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "key", "text", "heading", 10, 10)


# ---- 6 and 7: defects and cut texts


@pytest.mark.parametrize(
    "question,answer,want",
    [
        ("What is covered?", None, "empty_answer"), ("What is covered?", " \n​", "empty_answer"), ("What is covered?", "N/A", "empty_answer"), ("What is covered?", "Answer:", "empty_answer"),
        ("Is hernia repair covered after 20 days?", "IS HERNIA REPAIR COVERED AFTER 20 DAYS", "copies_question"), ("Is hernia repair covered after 20 days?", "You asked: Is hernia repair covered after 20 days?", "copies_question"),
        ("What is covered?", "Sorry, I cannot help with that request.", "refusal"), ("¿Qué cubre la póliza?", "Lo siento, no puedo responder a esa pregunta.", "refusal"), ("What is covered?", "I could not find any information about it. Thank you for your patience.", "refusal"),
        ("What is covered?", "Unfortunately it is excluded here. The claims desk refunds 20% of the bill.", None), ("What is covered?", "I regret the delay in answering. Premium falls due every 6 months.", None),
        ("What is covered?", "No.", None), ("What is covered?", "Not covered.", None), ("What is covered?", "No, it is excluded.", None),
        ("What is the limit for this?", "Die Abteilung hat das Rezept geprüft und für die Dialyse freigegeben.", "other_language"), ("What is the limit for this? (reply in German)", "Die Abteilung hat das Rezept geprüft und für die Dialyse freigegeben.", None),
        (None, "Die Abteilung hat das Rezept geprüft.", None), ("", "Fine for all of them.", None),
        ("Is it covered?", "is it covered", "copies_question"), ("उत्तर क्या है?", "उत्तर", "empty_answer"),
        ("What is covered?", "Having read " + "every clause and " * 40 + "schedule, I cannot help with that request. " + "Please contact the desk.", "refusal"),
    ],
)
def test_own_defects(question, answer, want):
    from lorikeet.llm.pairs import own_defect

    assert own_defect(question, answer) == want


def test_cut_texts(spark):
    from lorikeet.llm.pairs import broken_pairs
    from lorikeet.llm.truncation import find_truncated

    ITEMS = ["Hearing aids", "Home nursing"]
    rnd = random.Random(6)
    full = [f"The claims desk refunds {rnd.randrange(90)} rupees within {rnd.randrange(90)} days. The member sends the original prescription to the regional office per eye.\n- {rnd.choice(ITEMS)}\n- {rnd.choice(ITEMS)}" if k % 3 == 0 else f"Premium falls due every {rnd.randrange(90)} days and the member sends the original prescription of Rs. {k}00." for k in range(120)]
    cases = {
        "The member sends the original prescr": True,
        "The member sends the original prescr...": True,
        "The member sends the original prescription to the…": True,
        "The member sends the original prescription to the regional office per eye.": False,
        "The member sends the original prescription to the regional office per eye....": False,
        "(The member sends it to the regional office per eye.)": False,
        "The member sends it to the regional office per eye. 🙂": False,
        "40 per eye": False,
        "Premium falls due:\n- Hearing aids\n- Home nursing": False,
        "Premium falls due:\n- Hearing aids\n- Home nurs": True,
        "Yes.": False,
        "No.": False,
        "": False,
        "N/A": False,
        "The claims desk received the prescription of Rs.": True,
        "The desk refunds the prescription of Rs. 900.": False,
    }
    rows = [(f"f{k}", t, None) for k, t in enumerate(full)] + [(t, t, None) for t in cases] + [("null", None, None), ("copy", "where is my claim for the hearing aids", "Where is my claim for the hearing aids?")]
    df = spark.createDataFrame(rows + rows[:5], "key string, text string, prompt string")
    got = [r.key for r in find_truncated(df).collect()]
    assert sorted(got) == sorted(k for k, cut in cases.items() if cut)
    assert find_truncated(df.limit(0)).count() == 0
    pairs = spark.createDataFrame([(k, None, t) for k, (_, t, _) in enumerate(rows)] + [(None, "q", "a")], "id long, question string, answer string").withColumn("defect", F.lit("clash"))
    found = {r.id: r.defect for r in broken_pairs(pairs, "id", "question", "answer").collect()}
    assert {rows[i][0] for i, d in found.items() if d == "truncated_answer"} == {*got, "copy"}  # no question here


@pytest.mark.parametrize("longer,cut", [("limits", True), ("charges", False)])
def test_trie_decides(spark, longer, cut):
    """An unknown last token is a cut only where known words go on from it: the same
    values are complete in a corpus without such a word."""
    from lorikeet.llm.truncation import find_truncated

    rows = [(f"full{k}", f"The desk sends all {longer} of the room within {k} days.\n- Hearing aids\n- Home nursing") for k in range(9)]
    rows += [("phrase", "Room lim"), ("line", "Due:\n- Hearing aids\n- Room lim")]
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "key string, text string, prompt string")
    assert sorted(r.key for r in find_truncated(df).collect()) == (["line", "phrase"] if cut else [])


def test_sentence_end_evidence_of_any_length(spark):
    from lorikeet.llm.truncation import find_truncated, last_words

    long = "x" * 200
    assert last_words(f"a {long} {long}. b", 404) == f"{long} {long}."
    rows = [("full", f"Ask the {long} {long}. It is closed."), ("same", f"{long} {long}"), ("other", f"{long} desk")]
    rows += [("desk", "The desk is closed.")]
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "key string, text string, prompt string")
    assert [r.key for r in find_truncated(df).collect()] == ["other"]


def test_gate_loses_no_refusal():
    from lorikeet.llm import pairs as P

    assert not P._MAY_REFUSE.open
    for s in ("it went wrong", "no hay información", "nicht gefunden: es findet sich dazu nichts", "i won’t be able to say", "उत्तर नहीं दे सकते"):
        assert not P._REFUSAL.search(s) or P._MAY_REFUSE(s), s


def test_short_field_limits_are_evidence(spark):
    from lorikeet.llm.truncation import find_truncated

    ends = ["regional office", "consent note", "claims desk", "hearing aids", "waiting period", "home nursing"]
    rows = [(f"full{k}", f"The member turns to the {e}. The desk pays {k} rupees per eye. It is closed.") for k, e in enumerate(ends)]
    # cut at 40 characters, behind words that end sentences elsewhere
    limit = [(f"cut{k}", ("The desk refunds abcdefghijklmnopqrst"[: 39 - len(e)].rstrip().ljust(39 - len(e), "x") + " " + e)) for k, e in enumerate(ends)]
    assert {len(t) for _, t in limit} == {40}
    # one form with other numbers, and a phrase said often, pile up too
    forms = [(f"form{k}", f"{k} rupees per eye") for k in range(10, 60)] + [(f"same{k}", "To the claims desk") for k in range(50)]
    alone = [("alone", "Turn to the home nursing")]
    words = [("words", " ".join(t for _, t in limit) + " To Turn rupees end.")]
    df = spark.createDataFrame([(k, t, None) for k, t in rows + limit + forms + alone + words], "key string, text string, prompt string")
    assert sorted(r.key for r in find_truncated(df).collect()) == sorted(k for k, _ in limit)


# ---- 8: encoding


def test_transducer_round_trip(tmp_path):
    from lorikeet.llm.transducer import Transducer, build

    rnd = random.Random(7)
    words = sorted({bytes(rnd.choice(b"abcd\xc3\xa9 ") for _ in range(rnd.randrange(0, 7))) for _ in range(3000)})
    rnd.shuffle(words)
    ids = [[k, k * 2][: rnd.randrange(1, 3)] for k in range(len(words))]
    for some in (words, words[:1], []):
        path = tmp_path / f"{len(some)}.bin"
        path.write_bytes(build(some, ids[: len(some)]))
        t = Transducer(str(path))
        got = t.lookup(some)
        assert [t.ids_of(k) for k in got.tolist()] == ids[: len(some)]
        missing = [w + b"z" for w in words[:50]] + [b"q"]
        assert (t.lookup(missing) == -1).all()


def test_merge_and_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from lorikeet.llm.tokenize import VOCABULARY, encode, load_ranks, merge, split_words

    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rnd = random.Random(8)
    alphabet = "abc  \n\t'sé½²Ⅷहिन्दी保险🙂​\x1c\x85\xa0…_-1234tre"
    texts = ["", "a", "<|endoftext|> x", "it's  we've\n\n\n x", "aaaa" * 2500, "\x1c\x1d a\x85b"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    assert all("".join(split_words(x)) == x for x in texts)
    ranks = load_ranks(VOCABULARY)
    assert [i for w in split_words(texts[3]) for i in merge(w.encode(), ranks)] == t.encode(texts[3], add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000, None), (0, "")], "key long, text string").withColumn("ids", F.lit("clash"))
    rows = encode(df, "key", "text", lexicon_size=40).collect()
    assert len(rows) == len(texts) + 2
    got = {r.key: list(r.ids) for r in rows}
    assert got[1000] == got[0] == []
    for k, x in enumerate(texts):
        assert got[k] == t.encode(x, add_special_tokens=False).ids, repr(x)
    assert encode(df.limit(0), "key", "text").count() == 0


# ---- 9: leaks


def leaks_brute(docs, items, run):
    import unicodedata

    def ws(t):
        t = "".join(c for c in unicodedata.normalize("NFKC", t or "") if unicodedata.category(c) != "Cf")
        return re.findall(r"[^\W_]+", t.lower())

    grams = defaultdict(set)
    for i, p in items:
        w = ws(p)
        for k in range(len(w) - run + 1):
            grams[tuple(w[k : k + run])].add(i)
    return {(d, i) for d, t in docs if d is not None for w in [ws(t)] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}


def test_leaks(spark, monkeypatch):
    from lorikeet.llm import leaks

    rnd = random.Random(9)
    items = [(i, text_of(rnd, rnd.randrange(30, 60))) for i in range(60)] + [(60, "too short"), (61, None), (62, "")]
    items += [(63, items[0][1]), (64, "the the the the the the the the the the the the the")]
    docs = []
    for d in range(150):
        w = text_of(rnd, rnd.randrange(0, 80)).split()
        if d % 3 == 0:
            src = rnd.choice(items[:60])[1].split()
            a = rnd.randrange(len(src) - 12)
            w[5:5] = src[a : a + rnd.choice((11, 12, 13, 25))]
        t = " ".join(w)
        docs.append((d, t.upper() if d % 4 == 0 else t.replace("c", "​c").replace("a", "ａ") if d % 5 == 0 else t))
    docs += [(500, None), (501, ""), (502, "the " * 5000), (None, items[0][1]), (0, docs[0][1])]
    ddf = spark.createDataFrame(docs, "d long, t string").withColumn("item_id", F.lit("clash"))
    idf = spark.createDataFrame(items, "i long, p string").withColumn("doc_id", F.lit("clash"))
    want = leaks_brute(docs, [x for x in items if x[1]], 12)
    for most in (512, 20):
        monkeypatch.setattr(leaks, "MAX_ITEMS", most)
        rows = leaks.find_leaks(ddf, "d", "t", idf, "i", "p").collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(want) and want
    assert leaks.find_leaks(ddf.limit(0), "d", "t", idf, "i", "p").count() == 0
    assert leaks.find_leaks(ddf, "d", "t", idf.limit(0), "i", "p").count() == 0


# ---- 10: abuse


def test_abuse(spark):
    from lorikeet.llm.abuse import THRESHOLD, score_texts

    bad = [
        "I will find you and break your stupid neck.", "what a useless sh1thead you are", "the agent is a b***h", "you f u c k i n g liar", "send me n​udes, baby", "People of that religion should be wiped out, they ruin everything.",
        "you are an idioooot", "you mo.ron", "Du bist ein verdammter Vollidiot.", "Ferme ta gueule, espèce de connard.", "Ojalá te mueras, idiota.", "ｙou ｄuｍｂass", "Hot girls online, watch them strip.", "चुप रह, हरामी, तेरी औकात क्या है।",
    ]
    fine = [
        "Damn, I forgot the consent note again, my own fault.", "A naked eye check of the wound is enough.", "The insect pest killed the crop, and the killer whale rider was a joke.", "Sexually transmitted infections are treated as any other illness.",
        "The caller used abusive language, so the office closed the call.", "Old people and immigrants are welcome here.", "Our rat bite claim was paid, what a beast of a summer.", "She was bitten by a dog and I hope the cancer treatment is covered.", "How many teeth are covered if you break your neck?", "People with a pre-existing disease send the form back.", "Con tu póliza se paga la operación.", "This stupid form took me 12 days, but the branch manager was kind about it.",
        "Screening for breast cancer and a rectal examination are covered.", "* item\n* a **bold** word @ 5$", "", " \n", "x" * 50_000, "a b c d e f g h " * 2000,
    ]
    rows = [(k, t) for k, t in enumerate(bad + fine)] + [(900, None), (None, bad[0]), (0, bad[0])]
    df = spark.createDataFrame(rows, "key long, text string").withColumn("score", F.lit("clash"))
    out = score_texts(df, "key", "text").collect()
    score = {r.key: r.score for r in out}
    assert set(score) == {k for k, _ in rows if k is not None}
    for k, t in enumerate(bad + fine):
        assert (score[k] >= THRESHOLD) == (k < len(bad)), t
    assert score[900] == 0
    assert score_texts(df.limit(0), "key", "text").count() == 0


def test_restoring_is_exact_at_every_size(sf):
    import itertools
    import math

    import pyarrow.parquet as pq

    from lorikeet.llm.abuse import LEXICON, MODEL_WORD
    from lorikeet.llm.deobfuscate import Restorer, gram_counts

    counts = Counter(w for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() for w in (t or "").lower().split() if re.match(MODEL_WORD, w))
    starred = {w: w[0] + "*" * (len(w) - 2) + w[-1] for w in LEXICON if re.fullmatch("[a-z]{3,10}", w)}
    for times in (1, 100, 10_000):
        r = Restorer(gram_counts({w: math.ceil(math.sqrt(n * times)) for w, n in counts.items()}), set(LEXICON))
        assert [s for s in starred.values() if r.decode(s) is None] == []
    assert r.decode("i******e") == "imbecile"
    for token in ("f**k", "b@5t@rd", "idioooot", "mo.ron", "1d10t", "हरा.मी", "é3é*"):
        steps = r.lattice(token)
        paths = {"".join(x) for x in itertools.product(*steps)}
        assert r._spelled(steps) == paths & r.lexicon and math.isclose(r._best(steps), max(map(r.score, paths)))


def test_every_scored_word_and_pattern_passes_the_gate():
    from lorikeet.llm.literals import required
    from lorikeet.llm import abuse as A
    from lorikeet.llm import abuse_words as W

    scorer = A.Scorer({})
    looked = []
    score, A.evidence = A.evidence, lambda s: looked.append(s) or score(s)
    try:
        for w in {*W.STRONG, *W.INSULT, *W.ADDRESSED, *W.SEXUAL, *W.SUGGESTIVE, *W.DEMEAN}:
            looked.clear()
            scorer.passages(f"so {w}, then")
            assert looked, w
        patterns = {
            "i will hurt you": A._THREATS, "i'll beat you": A._THREATS, "wait outside, i come with a knife": A._THREATS, "ich bring dich um": A._THREATS, "sale con": A._THREATS, "find you and break": A._THREATS, "hope she will choke": A._THREATS,
            "keep women out of here, they are bad": A._PHRASES, "foreigners stink like hell": A._PHRASES, "women don't deserve": A._PHRASES, "jews are a disease": A._PHRASES, "foreigners breed like": A._PHRASES,
        }
        for s, pattern in patterns.items():
            looked.clear()
            scorer.passages(s)
            assert pattern.search(s) and looked, s
    finally:
        A.evidence = score
    assert max(scorer.passages("Sexy nude pics, click tonight."))[0] >= A.THRESHOLD
    for p in W.THREATS + W.GROUP_PHRASES:
        pieces = required(p)
        assert pieces and min(map(len, pieces)) > 2, p
    assert required(r"\b(?:ab|cde?f)\b.{0,9}x+gh?i*j") == {"ab", "cd"}


def test_marks_at_edges_and_doubled_are_decoded():
    from lorikeet.llm.abuse import LEXICON
    from lorikeet.llm.deobfuscate import Restorer, gram_counts

    r = Restorer(gram_counts(dict.fromkeys([*WORDS, "it", "do", "bold"], 50)), set(LEXICON))
    for token, word in {
        "a55hole": "asshole", "pu55y": "pussy", "b00bs": "boobs", "5lut": "slut", "1diot": "idiot", "fa66ot": "faggot", "bitche$": "bitches", "idiot$": "idiots", "fuc*": "fuck", "*diot": "idiot", "!diot": "idiot",
        "mo.ron.": "moron.", "sh-it": "shit", "sh'it": "shit", "(5lut)": "(slut)", "sh1t!": "shit!", "5h17": "shit", "*diot or fuc*": "idiot or fuck",
    }.items():
        assert r.restore(f"you {token} there") == f"you {word} there"
    for plain in ("p19", "p-19", "19p", "dog's", "idiot!", "do*", "don't", "pre-existing", "2022-03-19", "a.b@home.test"):
        assert r.restore(f"you {plain} there") == f"you {plain} there"
    assert r.restore("**it is bold** and *bold*") == "it is bold and bold"
    assert r.restore("x" * 50_000 + "1 *a " + "a1," * 20_000)


def test_long_runs_of_stars_offer_every_letter(sf):
    import pyarrow.parquet as pq

    from lorikeet.llm.abuse import LEXICON, MODEL_WORD
    from lorikeet.llm.deobfuscate import Restorer, gram_counts

    counts = Counter(w for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() for w in (t or "").lower().split() if re.match(MODEL_WORD, w))
    r = Restorer(gram_counts({w: round(64 * n**0.5) for w, n in counts.items()}), set(LEXICON))
    assert r.decode("m**********r") == "motherfucker"
    for w in LEXICON:
        if re.fullmatch("[a-z]{10,}", w):
            assert r.decode(w[0] + "*" * (len(w) - 2) + w[-1]) is not None, w
    # more stars than hidden letters, and than any word has
    assert r.decode("motherf***************") == r.decode("motherf" + "*" * 60) == "motherfucker"


def test_disguises_in_every_script_of_the_lexicon():
    from lorikeet.llm.abuse import LEXICON
    from lorikeet.llm.deobfuscate import Restorer, gram_counts

    r = Restorer(gram_counts(dict.fromkeys(["यह", "बीमा", "राशि", "está", "póliza", "über", *WORDS], 30)), set(LEXICON))
    for token, word in {"हरा.मी": "हरामी", "ह*ामी": "हरामी", "कमीीीीने": "कमीने", "कु-त्ते": "कुत्ते", "cabr*n": "cabron", "c@brón": "cabrón", "enc*lé": "enculé", "imbééécile": "imbécile", "est*pidó": None}.items():
        assert r.restore(f"तू {token} है") == f"तू {word or token} है", token
    for plain in ("बीमा-राशि", "क्या?", "über", "5 लाख", "नहीं।"):
        assert r.restore(f"यह {plain} है") == f"यह {plain} है"


def test_restorer_decides_disguised_insults():
    """Ablation: planted disguises are offences only through the restorer."""
    from lorikeet.llm.abuse import THRESHOLD, Scorer, counted_words
    from lorikeet.llm.deobfuscate import gram_counts

    s = Scorer(gram_counts(dict(counted_words([" ".join(WORDS) + " you are a real here"] * 40))))
    planted = ["you are a real m0r0n here", "you are a real i*iot here", "you are a real b a s t a r d here", "you are a real wh.ore here", "you are a real assshooole here", "you are a real $lut here", "तुम एक ह*ामी हो"]
    top = lambda t: max((p[0] for p in s.passages(t)), default=0.0)
    assert all(top(t) >= THRESHOLD for t in planted)
    s.restorer.restore = lambda text: text
    assert not any(top(t) >= THRESHOLD for t in planted)


def test_fit_moves_from_the_prior_only_with_evidence():
    import numpy as np

    from lorikeet.llm.train_abuse import fit

    prior = np.array([4.0, 4.0, -3.0])
    docs = [(np.array([[1.0, 0.0]]), True)] * 30 + [(np.zeros((0, 2)), False)] * 200 + [(np.array([[0.0, 0.0]]), True)] * 3
    w = fit(docs, prior)
    assert w[0] > 4 and w[1] == 4 and w[2] < -3
    assert fit([(np.array([[1.0, 0.0]]), False)] * 50, prior)[0] < 3


@pytest.mark.parametrize("text,want", [("¿Cubre la póliza la resonancia si la prima esté pagada?", "es"), ("Wird die Dialyse bezahlt?", "de"), ("le délai est dépassé pour l'assuré", "fr"), ("How long is it?", "en"), ("क्या यह शामिल है?", "hi"), ("401 - 22", None), ("", None), ("Zelda", None)])
def test_language(text, want):
    from lorikeet.llm.languages import language

    assert language(text) == want
