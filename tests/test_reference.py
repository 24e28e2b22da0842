import bisect
import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorikeet.functions import text as T
from lorikeet.operators import chunking, search, store
from lorikeet.operators.lockout import lock_states

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "line,want",
    [("", False), ("  ", False), ("Hi", True), ("Hi there.", False), ("ALL CAPS LINE.", True), ("Title Case Line.", True), ("Don't Stop Now.", False),
     ("IV. " + "word " * 15 + ".", True), ("IVORY " + "word " * 12 + ".", False), ("word " * 17 + "policy end.", True), ("123 456.", False)],
)
def test_heading(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(T.is_heading("x").alias("h")).first().h is want


def paras(spark, text):
    df = spark.createDataFrame([(1, text, "clash")], "id int, text string, section string")
    return [(r.section, r.text) for r in chunking.paragraphs(df, "id", "text").orderBy("para_id").collect()]


def test_paragraphs(spark):
    assert paras(spark, "This is body.") == [("General", "This is body.")]
    assert paras(spark, "Intro\nBody one.\nBody two.") == [("Intro", "Body one.\nBody two.")]
    assert paras(spark, "Intro\nBody one.\n\nBody two.") == [("Intro", "Body one."), ("Intro", "Body two.")]
    assert paras(spark, "Intro\nOther") == paras(spark, "") == paras(spark, None) == []


@pytest.mark.parametrize("n,want", [(512, [(0, 512)]), (513, [(0, 512), (435, 78)]), (600, [(0, 512), (435, 165)]), (870, [(0, 512), (435, 435)]), (880, [(0, 512), (435, 445), (870, 10)])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, text string")
    assert [(r.start, r.n_tokens) for r in chunking.token_windows(df, ["id"], "text").orderBy("start").collect()] == want


def heading_plain(line):
    s = line.strip()
    if not s:
        return False
    n = len(s.split())
    import re

    return bool((n <= 12 and not s.endswith(".")) or re.match(r"(\d+[.)]|[IVX]+\.)", s) or s.isupper() or (s.istitle() and n <= 8) or any(k in s.lower() for k in T.SECTION_KEYWORDS))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB.1)Ix É'\t", max_size=40), min_size=1, max_size=60))
def test_heading_property(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, x string")
    assert {r.i: r.h for r in df.select("i", T.is_heading("x").alias("h")).collect()} == {i: heading_plain(x) for i, x in enumerate(lines)}


def test_index_parsing(spark):
    cases = {"4,2,0": [4, 2, 0], "4, 2,0\nprose": [4, 2, 0], "Chunk 1 and 2": [0, 1, 2, 3, 4], "-1,3": [1, 3], "1,1,1": [1, 1, 1], "9,8,7,6,5,0": [0, 1, 2, 3, 4], "none": [0, 1, 2, 3, 4], "": [0, 1, 2, 3, 4]}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.p for r in df.select("x", T.parsed_indices("x", F.lit(5).cast("bigint"), 5).alias("p")).collect()} == cases


def test_answer_parsing(spark):
    cases = {
        "Answer: A Justification: Referenced from Section: S": ("A", "Referenced from Section: S"),
        "Answer: A Justification: because": ("A", "because"),
        "A": ("A", ""),
        "Answer: A Answer: B": ("A  B", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = df.select("x", T.parsed_answer("x").alias("a"), T.parsed_justification("x").alias("j")).collect()
    assert {r.x: (r.a, r.j) for r in got} == cases


def test_nearest_against_brute_force(spark):
    rnd = random.Random(1)
    vecs = [(i, "ab"[i % 2], [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    vecs += [(100, "a", [0.0] * 8), (101, "a", None), (102, "a", [1.0] * 3), (103, "a", list(vecs[0][2]))]
    rows = spark.createDataFrame(vecs, "row_id long, collection string, vector array<double>").repartition(5)
    q = spark.createDataFrame([(0, None, vecs[0][2]), (1, "b", vecs[1][2]), (2, "none", vecs[2][2])], "query_id long, collection string, vector array<double>")

    def dist(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for block in (2, 1024):
        got = search.nearest(q, rows, 4, block).orderBy("query_id", "rank").collect()
        for qid, coll in ((0, None), (1, "b")):
            want = sorted((round(dist(vecs[qid][2], v), 9), i) for i, c, v in vecs if v and len(v) == 8 and any(v) and coll in (None, c))[:4]
            assert [(round(r.distance, 9), r.row_id) for r in got if r.query_id == qid] == want
        assert not [r for r in got if r.query_id == 2]


def test_scopes(spark):
    cases = [("x", "personal", "u", ["x"]), (None, "shared", "u", ["policy_documents"]), (None, "personal", "u", ["user_u_documents"]), (None, "personal", None, ["policy_documents"]), (None, "combined", "u", ["policy_documents", "user_u_documents"]), (None, "combined", "", ["policy_documents"]), (None, "odd", "u", ["policy_documents"])]
    df = spark.createDataFrame([c[:3] + (i,) for i, c in enumerate(cases)], "c string, s string, u string, i int")
    assert {r.i: r.x for r in df.select("i", search.scoped_collections(F.col("c"), F.col("s"), F.col("u")).alias("x")).collect()} == {i: c[3] for i, c in enumerate(cases)}


def fold(rows, limit, lock):
    out = {}
    seen = {}
    for u, i, t, f in rows:
        if None not in (u, i, t, f):
            seen[i] = min(seen.get(i, (t, u, f)), (t, u, f))
    for u in {x[1] for x in seen.values()}:
        failed, until, locked, locks, n = 0, None, 0, 0, 0
        for t, _, f in sorted((t, i, f) for i, (t, v, f) in seen.items() if v == u):
            n += 1
            if until is not None and until > t:
                locked += 1
            elif not f:
                failed, until = 0, None
            elif failed + 1 >= limit:
                failed, until, locks = 0, t + dt.timedelta(seconds=lock), locks + 1
            else:
                failed, until = failed + 1, None
        out[u] = (failed, until is not None, n, locked, locks)
    return out


def test_lockout_against_loop(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.5 else f"u{rnd.randrange(9)}", i, T0 + dt.timedelta(seconds=rnd.randrange(40_000)), rnd.random() < 0.7) for i in range(900)]
    rows += rows[:30] + [(None, 1000, T0, True), ("a", None, T0, True), ("a", 1001, None, True), ("a", 1002, T0, None)]
    df = spark.createDataFrame(rows, "u string, i long, t timestamp, f boolean")
    got = {r.username: (r.failed_attempts, r.locked_until_us is not None, r.n_attempts, r.n_while_locked, r.n_locks) for r in lock_states(df, "u", "t", "i", "f", 3, 600).collect()}
    assert got == fold(rows, 3, 600)
    assert lock_states(df.limit(0), "u", "t", "i", "f").count() == 0


@pytest.mark.parametrize("limit,lock,span", [(3, 600, 40_000), (5, 900, 9_000), (1, 50, 900), (4, 10_000, 40_000)])
def test_one_user_over_many_tasks(spark, limit, lock, span):
    """A user under attack, with hardly any success, is spread over all tasks and folded exactly."""
    rnd = random.Random(limit)
    rows = [("hot" if k % 20 else f"u{k % 7}", k, T0 + dt.timedelta(seconds=rnd.randrange(span)), rnd.random() < 0.98) for k in range(1200)]
    df = spark.createDataFrame(rows, "u string, i long, t timestamp, f boolean").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.username: (r.failed_attempts, r.locked_until_us is not None, r.n_attempts, r.n_while_locked, r.n_locks) for r in lock_states(df, "u", "t", "i", "f", limit, lock).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == fold(rows, limit, lock)


def test_transition_is_the_step_for_every_entry_state():
    from lorikeet.operators.lockout import _FREE, step, transition

    rnd = random.Random(3)
    for limit in (1, 2, 5):
        for _ in range(40):
            us = sorted(rnd.randrange(100) for _ in range(rnd.randrange(1, 30)))
            fail = [rnd.random() < 0.8 for _ in us]
            starts, sf, su, ef, eu = transition(us, fail, limit, 12)
            for failed, until in [(f, _FREE) for f in range(limit)] + [(0, u) for u in range(us[0] + 1, us[0] + 12)]:
                f, u = failed, until
                for t, x in zip(us, fail):
                    f, u, _ = step(f, u, t, x, limit, 12)
                if until == _FREE:
                    got = ef[failed], eu[failed]
                else:
                    k = bisect.bisect_left(starts, until)
                    got = (sf[k], su[k]) if k < len(us) else (failed, until)
                assert got == (f, u), (us, fail, failed, until)


def test_unknown_users_and_locked_events(spark):
    from lorikeet.operators.lockout import locked_events, login_outcomes

    rows = [("a", k, T0 + dt.timedelta(minutes=k), True) for k in range(7)] + [("ghost", 9, T0, True)]
    df = spark.createDataFrame(rows, "u string, i long, t timestamp, f boolean")
    users = spark.createDataFrame([("a",), ("b",)], "username string")
    o = login_outcomes(df, "u", "t", "i", "f", users=users)
    assert {r.username for r in o.collect()} == {"a"}
    got = locked_events(o).orderBy("id").collect()
    until = (T0 + dt.timedelta(minutes=19)).isoformat()
    assert [(r.id, r.event_type) for r in got] == [(5, "LOGIN_LOCKED"), (6, "LOGIN_LOCKED")] and got[0].metadata.startswith('{"locked_until": "' + until[:19])


def test_lockout_borders(spark):
    def run(seq):
        df = spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=m), f) for i, (m, f) in enumerate(seq)], "u string, i long, t timestamp, f boolean")
        r = lock_states(df, "u", "t", "i", "f").first()
        return r.failed_attempts, r.locked_until_us is not None, r.n_while_locked

    four = [(i, True) for i in range(4)]
    assert run(four) == (4, False, 0)
    assert run(four + [(4, True)]) == (0, True, 0)
    assert run(four + [(4, True), (5, True)]) == (0, True, 1)
    assert run(four + [(4, True), (19, True)]) == (1, False, 0)
    assert run(four + [(4, False), (5, True)]) == (1, False, 0)


def test_mutations(spark):
    old = spark.createDataFrame([("a", "user", 1), ("b", "user", None)], "k string, role string, n int")
    new = spark.createDataFrame([("b", "admin"), ("c", "admin")], "k string, role string")
    assert {tuple(r) for r in store.upsert(old, new, "k", ["role"]).collect()} == {("a", "user", 1), ("b", "admin", None), ("c", "admin", None)}
    assert {tuple(r) for r in store.insert_absent(old, new, "k").collect()} == {("a", "user", 1), ("b", "user", None), ("c", "admin", None)}
    assert {r.k for r in store.delete_matching(old, F.col("n") == 1).collect()} == {"b"}
    seq = spark.createDataFrame([("a", 1, T0), ("a", 2, T0), ("a", 3, None), ("b", 4, None)], "k string, id int, t timestamp")
    assert {(r.k, r.id) for r in store.latest_per(seq, ["k"], "t", "id").collect()} == {("a", 2), ("b", 4)}
    first = store.newest(seq, F.col("k") == "a", "t", "id").collect()
    assert [r.id for r in first] == [3, 2, 1]


def test_files(spark, tmp_path):
    import zipfile

    from lorikeet.sources.files import append_chunks, collection_table, scan_files, scan_folder, with_text

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"text of c")
    (tmp_path / "d.PDF").write_bytes(b"x")
    (tmp_path / "e.png").write_bytes(b"x")
    got = {r.doc_name: (r.kind, r.text, r.error is None) for r in with_text(scan_folder(spark, str(tmp_path), "*"), lambda b: b.decode()).collect()}
    assert got == {"a.docx": ("docx", "One\n\nTwo", True), "b.docx": ("docx", None, False), "c.pdf": ("pdf", "text of c", True), "d.PDF": ("pdf", "x", True), "e.png": ("image", "", True)}
    assert [r.doc_name for r in scan_folder(spark, str(tmp_path)).collect()] == ["c.pdf"]
    assert scan_files(spark, [str(tmp_path / "a.docx")]).count() == 0
    path = str(tmp_path / "table")
    for _ in range(2):
        append_chunks(spark.createDataFrame([("x_0", "t", "shared"), ("x_1", "t", "other")], "chunk_id string, text string, collection string"), path)
    assert collection_table(spark, path, ["shared"]).count() == 1
    assert collection_table(spark, path, ["none"]).count() == 0


def test_json_sink_and_paths(spark, tmp_path):
    from lorikeet.sources.files import safe_path, write_chunk_json

    df = spark.createDataFrame([("x_0", "t\nü", ("x", None))], "chunk_id string, text string, metadata struct<document_name:string,section_heading:string>")
    write_chunk_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).select("chunk_id", "text", "metadata.document_name").first() == ("x_0", "t\nü", "x")
    assert safe_path(str(tmp_path), "a.pdf") and safe_path(str(tmp_path), "../a.pdf") is None and safe_path(str(tmp_path), "/etc/passwd") is None


def test_collections_and_stored_files(spark, tmp_path):
    from lorikeet.operators.embedding import hashed_vector
    from lorikeet.sources import files as S

    docs = tmp_path / "in" / "sub"
    docs.mkdir(parents=True)
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"A body line that ends here.")
    (docs / "d.pdf").write_bytes(b"Another body line.")
    base, read = str(tmp_path / "in"), lambda b: b.decode()
    assert [r.doc_name for r in S.list_pdfs(spark, base).collect()] == ["a.pdf", "b.pdf"]
    assert S.stored_file(spark, base, "a.pdf").first().content == b"A body line that ends here."
    assert S.stored_file(spark, base, "../x.pdf").count() == 0 and S.stored_file(spark, base, "none.pdf").count() == 0
    assert {r.out_path: r.text for r in S.converted_tree(spark, base, read).collect()} == {"a.txt": "A body line that ends here.", "b.txt": "A body line that ends here.", "sub/d.txt": "Another body line."}
    with pytest.raises(FileNotFoundError):
        S.converted_tree(spark, base + "x")
    path = str(tmp_path / "table")
    assert S.open_or_create(spark, path, "empty", "l2") == {"name": "empty", "metric": "l2"} and S.open_or_create(spark, path, "empty")["metric"] == "l2"
    for _ in range(2):
        S.ingest_folder(spark, base, path, "shared", hashed_vector, read)
    rows = S.collection_table(spark, path, ["shared"]).collect()
    assert sorted(r.chunk_id for r in rows) == ["a.pdf_0", "b.pdf_0"] and all(len(r.vector) == 64 for r in rows)
    assert S.collections(spark, path) == {"empty": "l2", "shared": "cosine"}
    assert S.drop_collection(spark, path, "empty") and not S.drop_collection(spark, path, "empty") and S.collections(spark, path) == {"shared": "cosine"}
    assert S.delete_stored(spark, base, "a.pdf") and not S.delete_stored(spark, base, "a.pdf") and not S.delete_stored(spark, base, "../table")
    assert S.clear_folder(spark, base) == 2 and (docs / "d.pdf").exists()


def test_file_drops(spark, tmp_path):
    from lorikeet.sources.files import collection_table
    from lorikeet.streaming.ingest import ingest, upload_stream

    drop = tmp_path / "drop"
    drop.mkdir()
    out = str(tmp_path / "chunks")
    for k in range(2):
        (drop / f"d{k}.pdf").write_bytes(b"A body line that ends here.")
        ingest(upload_stream(spark, str(drop), "user_u_documents", lambda b: b.decode()), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.chunk_id for r in collection_table(spark, out, ["user_u_documents"]).collect()) == ["d0.pdf_0", "d1.pdf_0"]


def test_settings(spark):
    from lorikeet.config import Settings

    s = Settings.read({"LORIKEET_TOP": "7", "LORIKEET_WEB_ROUTE": "yes", "LORIKEET_WEAK_DISTANCE": "0.9"})
    assert (s.top, s.web_route, s.weak_distance, s.final) == (7, True, 0.9, 5)
    spark.conf.set("spark.lorikeet.top", "9")
    assert Settings.read({"LORIKEET_TOP": "7"}, spark).top == 9
    spark.conf.unset("spark.lorikeet.top")


def test_other_tokens(spark):
    from lorikeet.operators.chunking import Tokens, token_windows

    letters = Tokens(lambda t: F.split(t, ""), lambda t: F.array_join(t, ""))
    df = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "x string").withColumn("k", F.lit(1))
    got = sorted((r.start, r.n_tokens, r.text) for r in token_windows(df, ["k"], "x", 4, 0.25, letters).collect())
    assert got == [(0, 3, "abc"), (0, 4, "abcd"), (3, 4, "defg"), (6, 4, "ghij"), (9, 1, "j")]


def test_text_helpers(spark):
    rows = [(0, None, "2024-01-02T03:04:05"), (1_700_000_000_000_001, "", "2024-01-02T03:04:05.5+02:00"), (-1, "x", "broken")]
    df = spark.createDataFrame(rows, "us long, t string, iso string")
    got = df.select(T.iso_time("us").alias("i"), T.or_default("t", F.lit("d")).alias("d"), T.utc_micros("iso").alias("u"), T.fill("a {x} b {y}", x=F.col("t"), y=F.col("us")).alias("f")).collect()
    assert [r.i for r in got] == ["1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20.000001+00:00", "1969-12-31T23:59:59.999999+00:00"]
    zero = spark.createDataFrame([(0, "0", [], False, 0.0), (5, "x", [1], True, 2.5)], "i int, s string, a array<int>, b boolean, f double")
    d = zero.select(T.or_default("i", F.lit(9)), T.or_default("s", F.lit("d")), T.or_default("a", F.array(F.lit(7))), T.or_default("b", F.lit(True)), T.or_default("f", F.lit(1.5))).collect()
    assert [tuple(r) for r in d] == [(9, "0", [7], True, 1.5), (5, "x", [1], True, 2.5)]
    assert [r.d for r in got] == ["d", "d", "x"] and [r.u for r in got] == [1704164645000000, 1704157445500000, None] and got[2].f == "a x b -1"
    m = df.limit(1).select(T.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")), F.lit(None).cast("map<string,string>")).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}


def test_appends_and_schemas(spark):
    old = store.empty_table(spark, "audit_events")
    assert store.missing_values(old, "audit_events").count() == 0
    new = spark.createDataFrame([("u", "QUERY", T0 - dt.timedelta(seconds=k), k) for k in range(40)], "username string, event_type string, created_at timestamp, n int")
    one = store.append_rows(old, new, "id", "n", store.AUDIT_DEFAULTS)
    got = one.orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 41)) and [r.created_at for r in got] == sorted(r.created_at for r in got) and {r.metadata for r in got} == {"{}"}
    assert one.schema == old.schema and store.append_rows(one, new.limit(0), "id", "n", {}).count() == 40
    bad = one.withColumn("event_type", F.when(F.col("id") > 1, F.col("event_type")))
    assert store.missing_values(bad, "audit_events").count() == 1
    users = spark.createDataFrame([("a", "user")], "username string, role string").withColumn("failed_attempts", F.lit(2))
    names = spark.createDataFrame([("a",), ("root",), ("b",), ("b",), (None,)], "username string")
    assert {tuple(r) for r in store.register(users, names, ["root"]).collect()} == {("a", "user", 2), ("b", "user", 0)}


def test_shared_folder_must_be_named_off_local_masters(monkeypatch):
    from lorikeet import session

    class Held:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: Held()
        getConf = lambda self: {}

    with pytest.raises(RuntimeError):
        session.shared_dir(type("S", (), {"sparkContext": Context()})())


def test_streaming_ingest(spark, tmp_path):
    from lorikeet.sources.files import collection_table
    from lorikeet.streaming.ingest import document_stream, ingest

    drop, out = str(tmp_path / "drop"), str(tmp_path / "chunks")
    docs = spark.createDataFrame([("d.pdf", "shared", "Intro\nA body line that ends.\n\nAnother body line.")], "doc_name string, collection string, text string")
    for k in range(2):
        docs.write.mode("append").parquet(drop)
        ingest(document_stream(spark, drop), out, str(tmp_path / "cp")).awaitTermination()
    got = collection_table(spark, out, ["shared"]).collect()
    assert {r.chunk_id for r in got} == {"d.pdf_0", "d.pdf_1"} and len(got) == 2


def test_ask(spark):
    from lorikeet.plans.ask import NO_ANSWER, NO_MATCH, NO_REPLY, WEB_REPLY, Models, ask, index_chunks

    chunk = spark.createDataFrame(
        [("p_0", "waiting period for cataract surgery is two years", ("p", "Waiting"), "policy_documents"), ("p_1", "claims need an invoice", ("p", "Claims"), "policy_documents"), ("u_0", "my own cataract policy", ("u", None), "user_u_documents"), (None, "x", None, "policy_documents"), ("n", None, None, "policy_documents")],
        "chunk_id string, text string, metadata struct<document_name:string,section_heading:string>, collection string",
    )
    q = spark.createDataFrame([(1, "time before coverage starts for cataract surgery", "shared", "u", None), (2, "hello there", "shared", "u", None), (3, "cataract", "combined", "u", None), (4, "anything", "odd", "u", "missing"), (5, None, "shared", None, None)], "query_id long, question string, scope string, username string, collection string")
    index = index_chunks(chunk)
    r = {x.query_id: x for x in ask(q, index).collect()}
    assert r[1].rewritten_query == "waiting period for cataract surgery" and r[1].response.startswith("waiting period") and r[1].justification == "Referenced from Section: Waiting" and r[1].metadata.n_chunks == 2 and r[1].metadata.original_query == r[1].rewritten_query
    assert r[2].route_taken == "direct_llm" and r[2].rewritten_query is None and r[3].metadata.n_chunks == 3 and r[4].response == NO_MATCH and r[4].success and r[5].response == NO_MATCH
    assert [s.document for s in r[1].sources] == ["p", "p"] and r[1].sources[0].text.endswith("...") and r[1].metadata.top_chunk_distance < 1
    picky = Models(rerank=lambda prompt, question, chunks: F.when(prompt.contains("Chunk 0:"), "1"))
    assert {x.query_id: x.metadata.n_chunks for x in ask(q, index, picky).collect()}[1] == 1
    # failing models
    none = lambda *_: F.lit(None).cast("string")
    f = {x.query_id: x for x in ask(q, index, Models(route=none, rewrite=none, rerank=none, answer=none, direct=none)).collect()}
    assert f[2].route_taken == "rag" and f[1].rewritten_query == "time before coverage starts for cataract surgery" and f[1].response == NO_ANSWER and f[1].sources == [] and f[1].success
    assert {x.query_id: x for x in ask(q, index, Models(direct=none)).collect()}[2].response == NO_REPLY
    # the older dispatch
    old = {x.query_id: x for x in ask(q, index, legacy=True).collect()}
    assert old[4].error == "Unknown scope: odd" and old[4].route_taken == "error" and not old[4].success and old[2].route_taken == "rag"
    far = Models(embed=lambda t: F.when(t.startswith("waiting period for cataract surgery is"), F.array(F.lit(-1.0), F.lit(0.0))).when(t.contains("invoice"), F.array(F.lit(-1.0), F.lit(0.1))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    w = {x.query_id: x for x in ask(q, index_chunks(chunk, far), far, web=True).collect()}
    assert w[1].route_taken == "web_scraping" and w[1].response == WEB_REPLY and not w[1].success and w[1].needs_web_scraping and w[3].needs_web_scraping and not w[4].needs_web_scraping


def test_each_model_is_called_once(spark):
    from lorikeet.plans.ask import Models, ask, index_chunks

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(q):
        calls.add(1)
        return f"Answer: {q}"

    chunk = spark.createDataFrame([("p_0", "cataract surgery", ("p", "W"), "policy_documents")], "chunk_id string, text string, metadata struct<document_name:string,section_heading:string>, collection string")
    q = spark.createDataFrame([(k, "cataract", "shared", "u", None) for k in range(7)], "query_id long, question string, scope string, username string, collection string")
    out = ask(q, index_chunks(chunk), Models(answer=lambda prompt, question, chunks: counted(question)))
    assert out.count() == 7 and len(out.collect()) == 7 and calls.value == 7


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys, importlib.abc\nclass B(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p, t=None):\n        if n.startswith('lorikeet.llm'): raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, B())\nfrom lorikeet.plans import catalogue; assert 'p1_found' in catalogue.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)
