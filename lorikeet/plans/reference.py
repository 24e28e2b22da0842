"""Queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.functions import text as T
from lorikeet.operators import chunking, embedding, search, store
from lorikeet.operators.lockout import lock_states, locked_events, login_outcomes
from lorikeet.plans.ask import ANSWER_PROMPT, NO_MATCH, RERANK_PROMPT, WEB_REPLY, DIRECT_REPLY, Models, ask, index_chunks
from lorikeet.sources.tables import table

HOT_USER = "branch.kiosk01"
QUERY_TEXT = "how long is the waiting period for cataract surgery in the policy"
EVERY = 50
#: Names of the collections in the tables.
COLLECTIONS = {"shared": "policy_shared", "personal": "user_{}"}


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))


def _asked(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return v.where(F.col("row_id") % EVERY == 0).select(F.col("row_id").alias("query_id"), "collection", "vector")


def knn_cosine_top15(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where("row_id = 0").select(F.col("row_id").alias("query_id"), F.lit(None).cast("string").alias("collection"), "vector")
    return search.nearest(q, v).select(F.col("row_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def knn_per_query(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = search.nearest(_asked(v).withColumn("collection", F.lit(None).cast("string")), v)
    return found.select("query_id", F.col("row_id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def weak_match_flag(spark: SparkSession, d: str) -> DataFrame:
    """Each query searches the collection five labels away; label 4 searches none."""
    v = _vectors(spark, d)
    q = _asked(v)
    far = F.when(q["collection"] == "4", F.lit("none")).otherwise(((q["collection"].cast("int") + 5) % 10).cast("string"))
    q = q.withColumn("collection", far)
    return search.weak_match(search.nearest(q, v), q).select("query_id", F.round("first_distance", 6).alias("first_distance"), "is_weak")


def combined_scope_concat(spark: SparkSession, d: str) -> DataFrame:
    """Even labels are the shared collection, odd ones the personal one."""
    v = _vectors(spark, d)
    rows = v.withColumn("collection", F.when(F.col("collection").cast("int") % 2 == 0, "shared").otherwise(search.personal_collection(F.lit("u"))))
    q = _asked(v).select("query_id", "vector", search.scoped_collections(F.lit(None).cast("string"), F.lit("combined"), F.lit("u"), "shared").alias("collections"))
    return search.concatenated(q, rows).select("query_id", "source_rank", "position", F.col("row_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def weighted_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of a row's label stands for its heading's vector."""
    v = _vectors(spark, d)
    found = search.nearest(_asked(v).withColumn("collection", F.lit(None).cast("string")), v)
    heads = v.groupBy("collection").agg(F.min(F.struct("row_id", "vector")).alias("h")).select(F.col("collection").alias("label"), F.col("h.vector").alias("hv"))
    rows = v.select("row_id", F.col("collection").alias("label"), F.col("vector").alias("tv")).join(heads, "label")
    qs = _asked(v).select("query_id", F.col("vector").alias("qv"))
    x = found.drop("collection").join(rows, "row_id").join(qs, "query_id")
    x = x.withColumn("text_similarity", search.cosine("qv", "tv")).withColumn("heading_similarity", search.cosine("qv", "hv"))
    return search.weighted_rerank(x).select("query_id", F.col("row_id").alias("vec_id"), F.round("combined_score", 6).alias("combined_score"), "new_rank")


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = chunking.lines(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return ls.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.col("is_heading").cast("bigint")).alias("n_headings"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "para_id", "section", "text")


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.token_windows(table(spark, d, "documents"), ["doc_id"], "text")
    return w.select("doc_id", "start", "n_tokens", F.md5("text").alias("text_md5"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunks(table(spark, d, "documents"), "doc_id", "doc_name", "text")
    return c.select(F.col("key").alias("doc_id"), "chunk_id", F.col("metadata.section_heading").alias("section"), F.md5("text").alias("text_md5"))


def hash_embed_knn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("row_id"), F.lit(None).cast("string").alias("collection"), embedding.hashed_vector("text").alias("vector"))
    q = spark.createDataFrame([(0, None, QUERY_TEXT)], "query_id bigint, collection string, t string").withColumn("vector", embedding.hashed_vector("t"))
    return search.nearest(q, docs).select(F.col("row_id").alias("doc_id"), F.round("distance", 6).alias("distance"))


def _replies(spark: SparkSession, d: str, reply: Column) -> DataFrame:
    """A model's reply for every history row, made from the row."""
    return table(spark, d, "query_history").select("id", "answer").distinct().select(F.col("id").alias("reply_id"), reply.alias("reply"))


def rerank_index_parse(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat_ws(",", (F.col("id") % 11).cast("string"), F.expr("id div 11 % 7").cast("string"), F.coalesce("answer", F.lit("")))
    return _replies(spark, d, reply).select("reply_id", F.array_join(T.parsed_indices("reply", F.lit(5).cast("bigint"), 5).cast("array<string>"), ",").alias("picked"))


def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_history").select("id", "answer", "justification").distinct()
    reply = F.concat(F.lit("Answer: "), F.coalesce("answer", F.lit("")), F.when(F.col("justification").isNull(), F.lit("")).otherwise(F.concat(F.lit(" Justification: "), F.col("justification"))))
    return q.select("id", T.parsed_answer(reply).alias("answer"), T.parsed_justification(reply).alias("justification"))


def source_preview(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return c.select("chunk_id", T.preview("text").alias("preview"))


def _first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first five chunks of each document as a prompt takes them."""
    c = table(spark, d, "chunk").where("chunk_id is not null and text is not null and metadata.document_name is not null")
    c = c.select("chunk_id", F.col("metadata.document_name").alias("document"), F.col("metadata.section_heading").alias("section"), "text").distinct()
    top = store.top_per(c, ["document"], [F.length("chunk_id").asc(), F.col("chunk_id").asc()], 5)
    return top.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("rank", "section", "text"))).alias("cs"))


def prompt_listing(spark: SparkSession, d: str) -> DataFrame:
    x = _first_chunks(spark, d)
    return x.select("document", F.md5(T.listing(F.col("cs"), 0, "Content")).alias("rerank_md5"), F.md5(T.listing(F.col("cs"), 1, "Text")).alias("answer_md5"))


def context_strings(spark: SparkSession, d: str) -> DataFrame:
    c = _first_chunks(spark, d)
    named = F.transform("cs", lambda c: F.struct(F.col("document").alias("document"), c["section"].alias("section"), c["text"].alias("text")))
    return c.select("document", F.md5(T.context_string(named)).alias("context_md5"))


def rerank_index_strict(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("id") % 13 == 0, "x").otherwise(F.expr("id div 72 % 6").cast("string"))
    reply = F.concat_ws(",", (F.col("id") % 8).cast("string"), F.concat(F.lit(" "), (F.expr("id div 8 % 9") - 3).cast("string")), last)
    return _replies(spark, d, reply).select("reply_id", F.array_join(T.strict_indices("reply", F.lit(5).cast("bigint"), 5).cast("array<string>"), ",").alias("picked"))


def answer_display(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_history").select("id", "answer", "justification", "sources").distinct()
    return q.select("id", T.shown_answer("answer").alias("answer"), T.shown_justification("justification", "sources").alias("justification"))


def history_top50(spark: SparkSession, d: str) -> DataFrame:
    h = store.newest(table(spark, d, "query_history"), F.col("username") == HOT_USER, "created_at", "id", 50)
    h = store.with_defaults(h, sources=F.array().cast(h.schema["sources"].dataType))
    return h.select("id", "question", "answer", F.size("sources").alias("n_sources"), F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def activity_top100(spark: SparkSession, d: str) -> DataFrame:
    a = store.newest(table(spark, d, "audit_events"), F.col("username") == HOT_USER, "created_at", "id", 100)
    return store.with_defaults(a, metadata=F.lit("{}")).select("id", "event_type", T.shown_resource("resource_type", "resource_id").alias("resource"), "metadata", F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def recent_queries_top5(spark: SparkSession, d: str) -> DataFrame:
    a = store.newest(table(spark, d, "audit_events"), (F.col("username") == HOT_USER) & (F.col("event_type") == "QUERY"), "created_at", "id", 5)
    return a.select("id", "resource_id", F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def files_by_scope(spark: SparkSession, d: str) -> DataFrame:
    f = store.newest(table(spark, d, "uploaded_files"), F.col("scope") == "shared", "uploaded_at", "id")
    f = store.with_defaults(f, size_bytes=F.lit(0).cast("bigint"))
    return f.select("id", "filename", T.or_default("username", F.lit("admin")).alias("username"), "size_bytes", F.coalesce(F.unix_micros("uploaded_at"), F.lit(-1)).alias("uploaded_us"))


def user_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "users").where(F.col("username") == HOT_USER).select("username", "role", "failed_attempts", F.coalesce(F.unix_micros("locked_until"), F.lit(-1)).alias("locked_us"), F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def exists_check(spark: SparkSession, d: str) -> DataFrame:
    return store.existing(table(spark, d, "users").select("username"), table(spark, d, "query_history"), F.col("username"), F.lower(T.strip("username")))


def upsert_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth user by length of name becomes admin; two seeds are new."""
    users = table(spark, d, "users")
    seeds = users.where("length(username) % 10 = 0").select("username").unionByName(spark.createDataFrame([("seed.admin.a",), ("seed.admin.b",)], "username string"))
    out = store.upsert(users, seeds.withColumn("role", F.lit("admin")), "username", ["role"])
    return out.select("username", "role", F.coalesce("failed_attempts", F.lit(-1)).alias("failed_attempts"), F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select("username", "role")
    new = spark.createDataFrame([(HOT_USER, "admin"), ("new.user", "user")], "username string, role string")
    return store.insert_absent(users, new, "username")


def replace_latest_personal(spark: SparkSession, d: str) -> DataFrame:
    """One personal file per user, the newest; shared files all stay."""
    f = table(spark, d, "uploaded_files").distinct()
    personal = store.latest_per(f.where("scope = 'personal' and username is not null"), ["username"], "uploaded_at", "id")
    rest = store.delete_matching(f, (F.col("scope") == "personal") & F.col("username").isNotNull())
    return rest.unionByName(personal).select("id", "filename", "scope", "username")


def delete_matching(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "uploaded_files").distinct()
    return store.delete_matching(f, (F.col("scope") == "personal") & (F.col("username") == HOT_USER)).select("id", "filename", "scope", "username")


def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_events").select("id", "event_type", "metadata").distinct()
    m = a.select("event_type", store.json_field("metadata", "$.scope").alias("scope"), store.json_field("metadata", "$.query_length").cast("bigint").alias("n"))
    return m.groupBy("event_type", "scope").agg(F.count("*").alias("n_events"), F.count("n").alias("n_lengths"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum_length"))


def route_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Answers read as if they were a classifier's replies."""
    return _replies(spark, d, F.when(F.col("id") % 3 == 0, " Direct ").otherwise(F.coalesce("answer", F.lit("")))).select("reply_id", T.normal_route("reply").alias("route"))


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_history").select("id", "question").distinct()
    return q.groupBy(T.question_route("question").alias("route")).agg(F.count("*").alias("n_questions"))


def glossary_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Questions in everyday wording: each term of the glossary in a history question's place."""
    q = table(spark, d, "query_history").where("question is not null").select("id", "question").distinct()
    worded = F.replace(F.replace("question", F.lit("waiting period"), F.lit("time before coverage starts")), F.lit("room rent"), F.lit("room cost"))
    return q.select("id", T.rewrite_question(worded).alias("rewritten"))


def password_rules(spark: SparkSession, d: str) -> DataFrame:
    """Usernames read as passwords, every second one with a capital."""
    word = F.when(F.length("username") % 2 == 0, F.concat(F.upper(F.substring("username", 1, 1)), F.substring("username", 2, 100))).otherwise(F.col("username"))
    return table(spark, d, "users").select("username", T.password_problem(word).alias("problem"))


def _attempts(spark: SparkSession, d: str) -> tuple:
    a = table(spark, d, "audit_events").where("event_type in ('LOGIN_FAIL', 'LOGIN_SUCCESS')")
    return a, F.lower(T.strip("username")), "created_at", "id", F.col("event_type") == "LOGIN_FAIL"


def _states(spark: SparkSession, d: str, **rule: int) -> DataFrame:
    s = lock_states(*_attempts(spark, d), users=table(spark, d, "users"), **rule)
    return s.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("locked_until_us", "last_login_us")})


def lockout_fold(spark: SparkSession, d: str) -> DataFrame:
    """Five failures lock for 15 minutes; unknown users are left out."""
    return _states(spark, d)


def lockout_fold_day(spark: SparkSession, d: str) -> DataFrame:
    """Three failures lock for a day, so that the tables hold many locked attempts."""
    return _states(spark, d, limit=3, lock_s=86400)


def lockout_events(spark: SparkSession, d: str) -> DataFrame:
    """The LOGIN_LOCKED row of every attempt that meets a lock of a day."""
    o = login_outcomes(*_attempts(spark, d), limit=3, lock_s=86400, users=table(spark, d, "users"))
    return locked_events(o).select("id", "username", "event_type", "metadata")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of questions, each asked in its scope."""
    q = table(spark, d, "query_history").where(F.col("id") % EVERY == 0).groupBy("id").agg(F.min(F.struct("question", "scope", "username")).alias("r"))
    return q.select(F.col("id").alias("query_id"), "r.question", "r.scope", F.lower(T.strip("r.username")).alias("username"), F.lit(None).cast("string").alias("collection"))


def _asked_rows(out: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return out.select(
        "query_id", "response", F.coalesce("justification", F.lit("")).alias("justification"), F.size("sources").alias("n_sources"), "route_taken", F.coalesce("rewritten_query", F.lit("")).alias("rewritten_query"), "success", "needs_web_scraping",
        m["classified_route"].alias("classified_route"), F.round(F.coalesce(m["top_chunk_distance"], F.lit(-1.0)), 6).alias("top_chunk_distance"), m["n_chunks"].alias("n_chunks"), F.coalesce("error", F.lit("")).alias("error"),
    )


def ask_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every question of the set from route to parsed answer, against all chunks."""
    return _asked_rows(ask(_questions(spark, d), index_chunks(table(spark, d, "chunk")), **COLLECTIONS))


def ask_sources(spark: SparkSession, d: str) -> DataFrame:
    """The source previews of each answer, in order."""
    out = ask(_questions(spark, d), index_chunks(table(spark, d, "chunk")), **COLLECTIONS)
    s = out.select("query_id", F.posexplode("sources").alias("pos", "s"))
    return s.select("query_id", "pos", F.coalesce("s.document", F.lit("")).alias("document"), F.coalesce("s.section", F.lit("")).alias("section"), F.col("s.text").alias("preview"))


def ask_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The older dispatch: no route, scopes alone; an unknown scope is an error row."""
    return _asked_rows(ask(_questions(spark, d), index_chunks(table(spark, d, "chunk")), legacy=True, **COLLECTIONS))


def _picky(prompt: Column, question: Column, chunks: Column) -> Column:
    """A re-ranker that reorders some lists, fails on some, and names chunks that aren't there."""
    n = F.length(question) % 3
    return F.when(prompt.contains("Chunk 0:") & (n == 0), "4,1").when(n == 2, "29, 2,0\nthe others don't fit")


def ask_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline with a re-ranking model; where it fails the order stays."""
    return _asked_rows(ask(_questions(spark, d), index_chunks(table(spark, d, "chunk")), Models(rerank=_picky), **COLLECTIONS))


def ask_web(spark: SparkSession, d: str) -> DataFrame:
    """The stated set with the web route for questions whose nearest chunk is far."""
    q = _questions(spark, d).withColumn("question", F.when(F.col("query_id") % 100 == 0, F.lit("zzz qqq")).otherwise(F.col("question")))
    return _asked_rows(ask(q, index_chunks(table(spark, d, "chunk")), web=True, **COLLECTIONS))


def prompts_filled(spark: SparkSession, d: str) -> DataFrame:
    """Both prompts with the first five chunks of each document."""
    x = _first_chunks(spark, d)
    q = F.lit(QUERY_TEXT)
    return x.select("document", F.md5(T.fill(RERANK_PROMPT, question=q, chunks=T.listing(F.col("cs"), 0, "Content"))).alias("rerank_md5"), F.md5(T.fill(ANSWER_PROMPT, question=q, chunks=T.listing(F.col("cs"), 1, "Text"))).alias("answer_md5"))


def files_by_user(spark: SparkSession, d: str) -> DataFrame:
    """A user's personal files, newest first."""
    f = store.newest(table(spark, d, "uploaded_files"), (F.col("scope") == "personal") & (F.col("username") == HOT_USER), "uploaded_at", "id")
    return f.select("id", "filename", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce(F.unix_micros("uploaded_at"), F.lit(-1)).alias("uploaded_us"))


def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """An upload event per file, appended behind the events that are there."""
    old = table(spark, d, "audit_events")
    f = table(spark, d, "uploaded_files").distinct().where("uploaded_at is not null")
    new = f.select(
        F.col("username"), F.lit("user").alias("role"), F.lit("UPLOAD").alias("event_type"), F.lit("file").alias("resource_type"), F.col("filename").alias("resource_id"),
        F.when(F.col("size_bytes").isNotNull(), F.to_json(F.struct("size_bytes"))).alias("metadata"), F.col("uploaded_at").alias("created_at"), F.col("id").alias("n"),
    )
    out = store.append_rows(old, new, "id", "n", store.AUDIT_DEFAULTS)
    return out.select("id", "username", "event_type", "resource_id", "metadata", F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"))


def history_append(spark: SparkSession, d: str) -> DataFrame:
    """The questions of one user asked again, appended without answer and sources."""
    old = table(spark, d, "query_history")
    again = old.where((F.col("username") == HOT_USER) & F.col("created_at").isNotNull()).distinct()
    new = again.select("username", "role", "scope", "question", F.col("created_at"), F.col("id").alias("n"))
    out = store.append_rows(old, new, "id", "n", store.HISTORY_DEFAULTS)
    return out.select("id", "username", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.size("sources"), F.lit(-1)).alias("n_sources"))


def delete_and_audit(spark: SparkSession, d: str) -> DataFrame:
    """A user's personal files are deleted: the rows go and one event each is appended."""
    f = table(spark, d, "uploaded_files").distinct()
    mine = (F.col("scope") == "personal") & (F.col("username") == HOT_USER)
    left = store.delete_matching(f, mine)
    gone = f.where(mine & F.col("uploaded_at").isNotNull()).select("username", F.lit("user").alias("role"), F.lit("DELETE").alias("event_type"), F.lit("file").alias("resource_type"), F.col("filename").alias("resource_id"), F.col("uploaded_at").alias("created_at"), F.col("id").alias("n"))
    events = store.append_rows(table(spark, d, "audit_events"), gone, "id", "n", store.AUDIT_DEFAULTS).where("event_type = 'DELETE'")
    what = lambda df, kind: df.select(F.lit(kind).alias("what"), "id", F.col("filename" if kind == "file" else "resource_id").alias("filename"))
    return what(left, "file").unionByName(what(events, "event"))


def required_values(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each operational table, and those that break its rule of required columns."""
    out = None
    for name in store.REQUIRED:
        t = table(spark, d, name)
        one = t.agg(F.count("*").alias("n_rows")).crossJoin(store.missing_values(t, name).agg(F.count("*").alias("n_broken")))  # one row each
        one = one.select(F.lit(name).alias("table_name"), F.lit(len(store.empty_table(spark, name).columns)).alias("n_columns"), "n_rows", "n_broken")
        out = one if out is None else out.unionByName(one)
    return out


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as ISO texts, and read back from a text without a zone."""
    e = table(spark, d, "audit_events").where("created_at is not null").select("id", F.unix_micros("created_at").alias("us")).distinct()
    iso = T.iso_time("us")
    return e.select("id", iso.alias("iso"), T.utc_micros(F.regexp_replace(iso, r"\+00:00$", "")).alias("us"))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """An event's metadata with its type and resource laid over it."""
    a = table(spark, d, "audit_events").select("id", "event_type", "resource_type", "metadata").distinct()
    own = F.map_filter(F.create_map(F.lit("scope"), store.json_field("metadata", "$.scope"), F.lit("event"), F.lit("unknown")), lambda k, v: v.isNotNull())
    over = F.map_filter(F.create_map(F.lit("event"), F.col("event_type"), F.lit("resource"), F.col("resource_type")), lambda k, v: v.isNotNull())
    m = T.merged(own, over)
    return a.select("id", *(F.coalesce(m[k], F.lit("-")).alias(k) for k in ("scope", "event", "resource")), F.size(F.map_keys(m)).alias("n_keys")).distinct()


def registered_users(spark: SparkSession, d: str) -> DataFrame:
    """New names that are neither reserved nor taken are added with their defaults."""
    users = table(spark, d, "users")
    asked = table(spark, d, "query_history").select(F.concat(F.lit("new."), F.lower(T.strip("username"))).alias("username")).distinct().unionByName(spark.createDataFrame([("Admin",), ("admin",), (HOT_USER,)], "username string"))
    out = store.register(users, asked, reserved=["admin"])
    return out.select("username", "role", F.coalesce("failed_attempts", F.lit(-1)).alias("failed_attempts"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine_top15, knn_per_query, weak_match_flag, combined_scope_concat, weighted_rerank, heading_lines, paragraphs, token_windows, chunk_ids,
        hash_embed_knn, rerank_index_parse, rerank_index_strict, answer_parse, answer_display, source_preview, prompt_listing, context_strings, history_top50, activity_top100, recent_queries_top5, files_by_scope,
        user_point_lookup, exists_check, upsert_overlay, insert_absent, replace_latest_personal, delete_matching, json_metadata, route_normalise,
        question_routes, glossary_rewrite, password_rules, lockout_fold, lockout_fold_day, lockout_events, ask_pipeline, ask_sources, ask_legacy, ask_reranked, ask_web, prompts_filled, files_by_user, audit_append, history_append, delete_and_audit, required_values, iso_times, metadata_merge, registered_users,
    )
}

_COS = "1 - list_dot_product({a}::double[], {b}::double[]) / sqrt(list_dot_product({a}::double[], {a}::double[]) * list_dot_product({b}::double[], {b}::double[]))"
_DIST = f"round({_COS.format(a='q.embedding', b='r.embedding')}, 12)"
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_JWS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_JWS}+|{_JWS}+$', '', 'g')"


_KEYWORDS = " or ".join(f"contains(lower(s), '{k}')" for k in T.SECTION_KEYWORDS)
_LINES = rf"""
d as (select doc_id, doc_name, string_split(text, chr(10)) as parts from documents where text is not null),
l0 as (select doc_id, doc_name, unnest(range(len(parts)))::int as ln, unnest(parts) as raw from d),
l1 as (select *, {_strip('raw')} as s from l0),
l2 as (select *, case when s = '' then 0 else len(regexp_split_to_array(s, '{_JWS}+')) end as nw from l1),
l as (select doc_id, doc_name, ln, s, s <> '' and (
        (nw <= 12 and not suffix(s, '.')) or regexp_matches(s, '^(\p{{Nd}}+[.)]|[IVX]+\.)')
        or (regexp_matches(s, '\p{{Lu}}') and not regexp_matches(s, '[\p{{Ll}}\p{{Lt}}]'))
        or (nw <= 8 and regexp_matches(s, '[\p{{Lu}}\p{{Lt}}]') and not regexp_matches(s, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}') and not regexp_matches(s, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]'))
        or {_KEYWORDS}) as h from l2)"""
_PARAS = (
    _LINES
    + """,
g as (select *, sum(case when h or s = '' then 1 else 0 end) over (partition by doc_id order by ln rows unbounded preceding) as isl,
             coalesce(last_value(case when h then s end ignore nulls) over (partition by doc_id order by ln rows between unbounded preceding and current row), 'General') as section from l),
b as (select doc_id, doc_name, isl, min(section) as section, string_agg(s, chr(10) order by ln) as text from g where not h and s <> '' group by all),
p as (select doc_id, doc_name, section, text, (row_number() over (partition by doc_id order by isl) - 1)::int as para_id from b)"""
)


def _windows(src: str, keys: str) -> str:
    return rf"""
w0 as (select {keys}, text, case when {_strip('text')} = '' then [] else regexp_split_to_array({_strip('text')}, '{_JWS}+') end as t from {src} where text is not null),
w1 as (select *, unnest(case when len(t) <= 512 then [0] else range(0, len(t), 435) end)::int as start from w0),
w as (select {keys}, start, case when len(t) <= 512 then len(t) else len(list_slice(t, start + 1, start + 512)) end::int as n_tokens,
             case when len(t) <= 512 then text else array_to_string(list_slice(t, start + 1, start + 512), ' ') end as wtext from w1)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FIRST_CHUNKS = """c as (select distinct chunk_id, metadata.document_name as document, metadata.section_heading as section, text from chunk where chunk_id is not null and text is not null and metadata.document_name is not null),
        t as (select *, row_number() over (partition by document order by length(chunk_id), chunk_id) as rk from c qualify rk <= 5)"""


def _lock_sql(limit: int, lock_s: int) -> str:
    """Every attempt of known users folded one after the other: ``s`` with the state behind attempt ``rn``."""
    return f"""with recursive a as (select distinct id, lower({_strip('username')}) as u, epoch_us(created_at) as us, event_type = 'LOGIN_FAIL' as f from audit_events
          where event_type in ('LOGIN_FAIL', 'LOGIN_SUCCESS') and username is not null and created_at is not null and id is not null and lower({_strip('username')}) in (select username from users)),
        o as (select *, row_number() over (partition by u order by us, id) as rn, count(*) over (partition by u) as n from a),
        s as (select u, 0::bigint as rn, 0::bigint as id, 0::bigint as failed, null::bigint as lock, 0::bigint as locked, 0::bigint as locks, false as met, -1::bigint as login from (select distinct u from o)
          union all select s.u, o.rn, o.id, case when lock > us then failed when not f then 0 when failed + 1 >= {limit} then 0 else failed + 1 end,
            case when lock > us then lock when not f then null when failed + 1 >= {limit} then us + {lock_s * 1_000_000} else null end,
            locked + case when lock > us then 1 else 0 end, locks + case when not coalesce(lock > us, false) and f and failed + 1 >= {limit} then 1 else 0 end,
            coalesce(lock > us, false), case when not f and not coalesce(lock > us, false) then us else login end
          from s join o on o.u = s.u and o.rn = s.rn + 1)"""


_STATE_SQL = """ select s.u as username, failed as failed_attempts, coalesce(lock, -1) as locked_until_us, n as n_attempts, locked as n_while_locked, locks as n_locks, login as last_login_us from s join o on o.u = s.u and o.rn = s.rn where s.rn = n"""


def _hashed_sql(x: str) -> str:
    """Counts by bucket of the tokens of a text, as the stand-in of an embedding."""
    return f"list_transform(range(64), lambda b: len(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % 64 = b))::double)"


def _ask_sql(legacy: bool = False, web: bool = False, picks: str = "[0, 1, 2, 3, 4]") -> str:
    """Route, rewriting, search per collection, weighted re-ranking and the first five chunks as tables."""
    term = "question"
    for k, v in T.GLOSSARY.items():
        term = f"replace({term}, {_quoted(k)}, {_quoted(v)})"
    question = "case when id % 100 = 0 then 'zzz qqq' else question end" if web else "question"
    direct = "false" if legacy else f"coalesce(regexp_matches(lower({_strip('question')}), '{T.DIRECT_PATTERN}'), false)"
    own = "'user_' || coalesce(username, 'None')" if legacy else "'user_' || username"
    known = "true" if legacy else "coalesce(username, '') <> ''"
    other = "[]" if legacy else "['policy_shared']"
    cos = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"
    safe = lambda a, b: f"case when list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 then {cos.format(a, b)} else 0 end"
    return f"""with q0 as (select id as query_id, {question} as question, scope, username from (select id, min(row(question, scope, username)) as r, r[1] as question, r[2] as scope, lower({_strip('r[3]')}) as username from query_history where id % {EVERY} = 0 group by id)),
        q1 as (select *, {direct} as direct, {_strip(term)} as w from q0),
        q as (select *, case when coalesce(w, '') = '' then question else w end as rewritten,
          case when scope = 'shared' then ['policy_shared'] when scope = 'personal' and {known} then [{own}] when scope = 'combined' and {known} then ['policy_shared', {own}] else {other} end as cols from q1),
        qv as (select query_id, {_hashed_sql('rewritten')} as v, unnest(cols) as collection, unnest(range(len(cols))) as sr from q where not direct and rewritten is not null),
        c0 as (select chunk_id, collection, min(row(text, metadata.document_name, metadata.section_heading)) as r from chunk where chunk_id is not null and text is not null group by all),
        c as (select ('0x' || substr(md5(chunk_id || '|' || coalesce(collection, '')), 1, 15))::bigint as row_id, collection, r[1] as text, r[2] as document, r[3] as section, {_hashed_sql('r[1]')} as tv, {_hashed_sql("coalesce(r[3], '')")} as hv from c0),
        d as (select query_id, sr, row_id, text, document, section, v, tv, hv, round(1 - {cos.format('v', 'tv')}, 12) as dist from qv join c using (collection) where list_dot_product(v, v) > 0 and list_dot_product(tv, tv) > 0),
        n as (select *, row_number() over (partition by query_id, sr order by dist, row_id) as rk from d qualify rk <= 15),
        f as (select *, row_number() over (partition by query_id order by sr, rk) - 1 as position, 0.7 * ({safe('v', 'tv')}) + 0.3 * ({safe('v', 'hv')}) as score from n),
        w as (select *, row_number() over (partition by query_id order by round(score, 9) desc, position) as pos from f),
        size as (select query_id, min(dist) filter (where position = 0) as first, count(*) as m from w group by query_id),
        named as (select query_id, first, m, list_filter({picks}, lambda x: x < m) as ok from size join q using (query_id)),
        chosen as (select query_id, first, case when len(ok) > 0 then ok else range(least(m, 5)) end as ps from named),
        top5 as (select query_id, o as pos, document, section, text from (select query_id, unnest(ps) + 1 as pos, unnest(range(1, len(ps) + 1)) as o from chosen) join w using (query_id, pos)),
        one as (select query_id, first, len(ps)::int as n, text, coalesce(section, 'General') as section from chosen join top5 using (query_id) where pos = 1),
        reply as (select query_id, first, n, string_split('Answer: ' || text || ' Justification: Referenced from Section: ' || section, 'Justification:') as p from one),
        told as (select query_id, first, n, {_strip("replace(p[1], 'Answer:', '')")} as answer, case when len(string_split(p[2], 'Referenced from Section:')) > 1 then 'Referenced from Section: ' || {_strip("string_split(p[2], 'Referenced from Section:')[2]")} else {_strip('p[2]')} end as justification from reply),
        asked as (select q.query_id, direct, rewritten, n, first, answer, justification, coalesce(first > 1.2, false) as far, {'scope is null or scope not in (' + "'shared', 'personal', 'combined')" if legacy else 'false'} as bad, scope, {'true' if web else 'false'} as web from q left join told using (query_id))"""


_ASKED = f""" select query_id, case when bad then null when direct then {_quoted(DIRECT_REPLY)} when n is null then {_quoted(NO_MATCH)} when web and far then {_quoted(WEB_REPLY)} else answer end as response,
        case when web and far then '' else coalesce(justification, '') end as justification, case when web and far then 0 else coalesce(n, 0) end::int as n_sources,
        case when bad then 'error' when direct then 'direct_llm' when web and far then 'web_scraping' else 'rag' end as route_taken, case when bad or direct then '' else coalesce(rewritten, '') end as rewritten_query,
        not bad and not (web and far) as success, far as needs_web_scraping, case when direct then 'direct' else 'rag' end as classified_route, round(coalesce(first, -1.0), 6) as top_chunk_distance, coalesce(n, 0)::int as n_chunks,
        case when bad then 'Unknown scope: ' || coalesce(scope, 'None') else '' end as error from asked"""


_TOP = "qualify row_number() over (partition by q.vec_id order by {d}, r.vec_id) <= 15"
_NEWEST = "order by created_at desc nulls first, id desc"

ORACLE = {
    "knn_cosine_top15": f"""select r.vec_id, round({_DIST}, 6) as distance, row_number() over (order by {_DIST}, r.vec_id)::int as rank
        from embeddings r, (select * from embeddings where vec_id = 0) q qualify rank <= 15""",
    "knn_per_query": f"""select q.vec_id as query_id, r.vec_id, round({_DIST}, 6) as distance, row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id)::int as rank
        from embeddings q, embeddings r where q.vec_id % 50 = 0 qualify rank <= 15""",
    "weak_match_flag": f"""with f as (select q.vec_id, min({_DIST}) as d from embeddings q join embeddings r on r.label = (q.label + 5) % 10 where q.vec_id % 50 = 0 and q.label <> 4 group by all)
        select e.vec_id as query_id, round(coalesce(d, 2.0), 6) as first_distance, coalesce(d, 2.0) > 1.2 as is_weak from embeddings e left join f using (vec_id) where e.vec_id % 50 = 0""",
    "combined_scope_concat": f"""with f as (select q.vec_id as query_id, (r.label % 2)::int as source_rank, r.vec_id, {_DIST} as d,
          row_number() over (partition by q.vec_id, r.label % 2 order by {_DIST}, r.vec_id) as rk from embeddings q, embeddings r where q.vec_id % 50 = 0 qualify rk <= 15)
        select query_id, source_rank, (row_number() over (partition by query_id order by source_rank, rk) - 1)::int as position, vec_id, round(d, 6) as distance from f""",
    "weighted_rerank": f"""with f as (select q.vec_id as query_id, r.vec_id, r.label, q.embedding as qe, r.embedding as re, row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id) as rk
          from embeddings q, embeddings r where q.vec_id % 50 = 0 qualify rk <= 15),
        h as (select label, arg_min(embedding, vec_id) as he from embeddings group by label),
        s as (select query_id, vec_id, rk, 0.7 * (1 - ({_COS.format(a='qe', b='re')})) + 0.3 * (1 - ({_COS.format(a='qe', b='he')})) as sc from f join h using (label))
        select query_id, vec_id, round(sc, 6) as combined_score, row_number() over (partition by query_id order by round(sc, 9) desc, rk)::int as new_rank from s""",
    "heading_lines": f"with {_LINES} select doc_id, count(*) as n_lines, sum(h::int)::bigint as n_headings from l group by doc_id",
    "paragraphs": f"with {_PARAS} select doc_id, para_id, section, text from p",
    "token_windows": f"with {_windows('documents', 'doc_id')} select doc_id, start, n_tokens, md5(wtext) as text_md5 from w",
    "chunk_ids": f"""with {_PARAS}, {_windows('p', 'doc_id, doc_name, para_id, section')}
        select doc_id, concat_ws('_', coalesce(doc_name, ''), row_number() over (partition by doc_id order by para_id, start) - 1) as chunk_id, section, md5(wtext) as text_md5 from w""",
    "hash_embed_knn": rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from documents),
        u as (select doc_id, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 as bucket, count(*) as n from t group by all),
        qt as (select unnest(regexp_extract_all('{QUERY_TEXT}', '[a-z0-9]+')) as tok), q as (select ('0x' || substr(md5(tok), 1, 8))::bigint % 64 as bucket, count(*) as qn from qt group by all),
        s as (select doc_id, sum(n * coalesce(qn, 0))::double as d, sum(n * n)::double as nn from u left join q using (bucket) group by doc_id)
        select doc_id, round(round(1 - d / sqrt(nn * (select sum(qn * qn)::double from q)), 9), 6) as distance from s order by round(1 - d / sqrt(nn * (select sum(qn * qn)::double from q)), 9), doc_id limit 15""",
    "rerank_index_parse": f"""with r as (select distinct id as reply_id, concat_ws(',', id % 11, id // 11 % 7, coalesce(answer, '')) as reply from query_history),
        p as (select reply_id, list_transform(list_slice(list_filter(string_split(regexp_replace(split_part({_strip('reply')}, chr(10), 1), '[^0-9,]', '', 'g'), ','), lambda x: x <> ''), 1, 5), lambda x: try_cast(x as bigint)) as i from r),
        v as (select reply_id, list_filter(i, lambda x: x < 5) as i from p)
        select reply_id, array_to_string(case when len(i) > 0 then i else [0, 1, 2, 3, 4] end, ',') as picked from v""",
    "answer_parse": rf"""with q as (select distinct id, answer, justification from query_history),
        r as (select id, 'Answer: ' || coalesce(answer, '') || case when justification is null then '' else ' Justification: ' || justification end as reply from q),
        s as (select id, string_split(reply, 'Justification:') as p from r)
        select id, {_strip("replace(p[1], 'Answer:', '')")} as answer, case when len(p) < 2 then ''
          when len(string_split(p[2], 'Referenced from Section:')) > 1 then 'Referenced from Section: ' || {_strip("string_split(p[2], 'Referenced from Section:')[2]")} else {_strip('p[2]')} end as justification from s""",
    "source_preview": "select chunk_id, substr(min(text), 1, 200) || '...' as preview from chunk where chunk_id is not null and text is not null group by chunk_id",
    "prompt_listing": f"""with c as (select distinct chunk_id, metadata.document_name as document, metadata.section_heading as section, text from chunk where chunk_id is not null and text is not null and metadata.document_name is not null),
        t as (select *, row_number() over (partition by document order by length(chunk_id), chunk_id) as rk from c qualify rk <= 5)
        select document, md5(string_agg(chr(10) || 'Chunk ' || (rk - 1) || ':' || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Content: ' || text || chr(10) || repeat('-', 80) || chr(10), '' order by rk)) as rerank_md5,
          md5(string_agg(chr(10) || 'Chunk ' || rk || ':' || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Text: ' || text || chr(10) || repeat('-', 80) || chr(10), '' order by rk)) as answer_md5 from t group by document""",
    "context_strings": """with c as (select distinct chunk_id, metadata.document_name as document, metadata.section_heading as section, text from chunk where chunk_id is not null and text is not null and metadata.document_name is not null),
        t as (select *, row_number() over (partition by document order by length(chunk_id), chunk_id) as rk from c qualify rk <= 5)
        select document, md5(string_agg('[Document: ' || document || ']' || chr(10) || '[Section: ' || coalesce(section, 'None') || ']' || chr(10) || 'Content: ' || text || chr(10) || repeat('-', 80) || chr(10), chr(10) order by rk)) as context_md5 from t group by document""",
    "rerank_index_strict": f"""with r as (select distinct id as reply_id, answer, concat_ws(',', id % 8, ' ' || (id // 8 % 9 - 3), case when id % 13 = 0 then 'x' else (id // 72 % 6)::varchar end) as reply from query_history), p as (select reply_id, list_transform(string_split(reply, ','), lambda x: trim(x)) as t from r),
        v as (select reply_id, len(list_filter(t, lambda x: not regexp_matches(x, '^[+-]?[0-9]+$'))) > 0 as bad, list_filter(list_transform(list_slice(t, 1, 5), lambda x: try_cast(x as bigint)), lambda x: x < 5) as i from p),
        w as (select reply_id, bad, list_transform(i, lambda x: case when x < 0 then x + 5 else x end) as i from v)
        select reply_id, array_to_string(case when bad or len(list_filter(i, lambda x: x < 0)) > 0 then [0, 1, 2, 3, 4] else i end, ',') as picked from w""",
    "answer_display": """with q as (select distinct id, answer, justification, sources from query_history),
        s as (select id, answer, coalesce(justification, '') as j, case when len(sources) > 0 then 'Sources:' || chr(10) || array_to_string(list_transform(sources, lambda x: '- ' || coalesce(x.document, 'null') || ' :: ' || coalesce(x.section, 'null')), chr(10)) end as l from q)
        select id, case when answer is null or answer = '' then 'No answer returned.' else answer end as answer,
          case when l is null and j = '' then 'No justification returned.' when l is null then j when j = '' then l else j || chr(10) || chr(10) || l end as justification from s""",
    "history_top50": f"select id, question, answer, coalesce(len(sources), 0)::int as n_sources, coalesce(epoch_us(created_at), -1) as created_us from (select * from query_history where username = '{HOT_USER}' {_NEWEST} limit 50)",
    "activity_top100": f"""select id, event_type, case when coalesce(resource_type, '') = '' then '—' else resource_type || ': ' || coalesce(resource_id, 'None') end as resource, coalesce(metadata, '{{}}') as metadata, coalesce(epoch_us(created_at), -1) as created_us
        from (select * from audit_events where username = '{HOT_USER}' {_NEWEST} limit 100)""",
    "recent_queries_top5": f"select id, resource_id, coalesce(epoch_us(created_at), -1) as created_us from (select * from audit_events where username = '{HOT_USER}' and event_type = 'QUERY' {_NEWEST} limit 5)",
    "files_by_scope": "select id, filename, case when coalesce(username, '') = '' then 'admin' else username end as username, coalesce(size_bytes, 0) as size_bytes, coalesce(epoch_us(uploaded_at), -1) as uploaded_us from uploaded_files where scope = 'shared'",
    "user_point_lookup": f"select username, role, failed_attempts, coalesce(epoch_us(locked_until), -1) as locked_us, coalesce(epoch_us(created_at), -1) as created_us from users where username = '{HOT_USER}'",
    "exists_check": f"select username from users u where exists (select 1 from query_history q where lower({_strip('q.username')}) = u.username)",
    "upsert_overlay": """select username, case when length(username) % 10 = 0 then 'admin' else role end as role, coalesce(failed_attempts, -1) as failed_attempts, coalesce(epoch_us(created_at), -1) as created_us from users
        union all select unnest(['seed.admin.a', 'seed.admin.b']), 'admin', -1, -1""",
    "insert_absent": f"select username, role from users union all select * from (values ('{HOT_USER}', 'admin'), ('new.user', 'user')) n(username, role) where username not in (select username from users)",
    "replace_latest_personal": """with f as (select distinct * from uploaded_files), p as (select * from f where scope = 'personal' and username is not null
          qualify row_number() over (partition by username order by uploaded_at desc nulls last, id desc) = 1)
        select id, filename, scope, username from f where scope is distinct from 'personal' or username is null union all select id, filename, scope, username from p""",
    "delete_matching": f"select id, filename, scope, username from (select distinct * from uploaded_files) where not coalesce(scope = 'personal' and username = '{HOT_USER}', false)",
    "json_metadata": """with a as (select distinct id, event_type, metadata from audit_events),
        m as (select event_type, case when json_valid(metadata) then metadata ->> '$.scope' end as scope, case when json_valid(metadata) then (metadata ->> '$.query_length')::bigint end as n from a)
        select event_type, scope, count(*) as n_events, count(n) as n_lengths, coalesce(sum(n), 0)::bigint as sum_length from m group by all""",
    "route_normalise": """with r as (select distinct id as reply_id, answer, case when id % 3 = 0 then ' Direct ' else coalesce(answer, '') end as reply from query_history)
        select reply_id, case when contains(lower(reply), 'rag') then 'rag' when contains(lower(reply), 'direct') then 'direct' else 'rag' end as route from r""",
    "question_routes": rf"""select case when regexp_matches(lower({_strip('question')}), '{T.DIRECT_PATTERN}') then 'direct' else 'rag' end as route, count(*) as n_questions
        from (select distinct id, question from query_history) group by 1""",
    "glossary_rewrite": f"""select id, {_strip("replace(replace(question, 'time before coverage starts', 'waiting period'), 'room rent', 'room rent limit')")} as rewritten
        from (select distinct id, question from query_history where question is not null)""",
    "password_rules": r"""with w as (select username, case when length(username) % 2 = 0 then upper(substr(username, 1, 1)) || substr(username, 2) else username end as word from users)
        select username, case when length(word) < 12 then 'length' when not regexp_matches(word, '\p{Ll}') then 'lowercase' when not regexp_matches(word, '\p{Lu}') then 'uppercase'
        when not regexp_matches(word, '\p{Nd}') then 'digit' else '' end as problem from w""",
    "lockout_fold": _lock_sql(5, 900) + _STATE_SQL,
    "lockout_fold_day": _lock_sql(3, 86400) + _STATE_SQL,
    "lockout_events": _lock_sql(3, 86400) + """ select id, u as username, 'LOGIN_LOCKED' as event_type, '{"locked_until": "' || strftime(make_timestamp(lock), '%Y-%m-%dT%H:%M:%S')
        || case when lock % 1000000 <> 0 then '.' || lpad((lock % 1000000)::varchar, 6, '0') else '' end || '+00:00"}' as metadata from s where met""",
    "ask_pipeline": _ask_sql() + _ASKED,
    "ask_sources": _ask_sql() + """ select query_id, (pos - 1)::int as pos, coalesce(document, '') as document, coalesce(section, '') as section, substr(text, 1, 200) || '...' as preview from top5""",
    "ask_legacy": _ask_sql(legacy=True) + _ASKED,
    "ask_reranked": _ask_sql(picks="case length(rewritten) % 3 when 0 then [4, 1] when 2 then [29, 2, 0] else [0, 1, 2, 3, 4] end") + _ASKED,
    "ask_web": _ask_sql(web=True) + _ASKED,
    "delete_and_audit": f"""with f as (select distinct * from uploaded_files), g as (select * from f where coalesce(scope = 'personal' and username = '{HOT_USER}', false)), m as (select max(id) as m from audit_events)
        select 'file' as what, id, filename from f where not coalesce(scope = 'personal' and username = '{HOT_USER}', false) union all select 'event', id, resource_id from audit_events where event_type = 'DELETE' union all
        select 'event', m + row_number() over (order by uploaded_at, id), filename from g, m where uploaded_at is not null""",
    "required_values": " union all ".join(
        f"select '{t}' as table_name, {len(store.SCHEMAS[t].replace('struct<document:string,section:string,text:string>', '').split(','))} as n_columns, count(*) as n_rows, count(*) filter (where {' or '.join(f'{c} is null' for c in cs)}) as n_broken from {t}" for t, cs in store.REQUIRED.items()
    ),
    "prompts_filled": f"""with {_FIRST_CHUNKS},
        l as (select document, string_agg(chr(10) || 'Chunk ' || (rk - 1) || ':' || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Content: ' || text || chr(10) || repeat('-', 80) || chr(10), '' order by rk) as r,
          string_agg(chr(10) || 'Chunk ' || rk || ':' || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Text: ' || text || chr(10) || repeat('-', 80) || chr(10), '' order by rk) as a from t group by document)
        select document, md5(replace(replace({_quoted(RERANK_PROMPT)}, '{{chunks}}', r), '{{question}}', {_quoted(QUERY_TEXT)})) as rerank_md5, md5(replace(replace({_quoted(ANSWER_PROMPT)}, '{{chunks}}', a), '{{question}}', {_quoted(QUERY_TEXT)})) as answer_md5 from l""",
    "files_by_user": f"select id, filename, coalesce(size_bytes, 0) as size_bytes, coalesce(epoch_us(uploaded_at), -1) as uploaded_us from uploaded_files where scope = 'personal' and username = '{HOT_USER}'",
    "audit_append": """with f as (select distinct * from uploaded_files where uploaded_at is not null), m as (select max(id) as m from audit_events)
        select id, username, event_type, resource_id, metadata, coalesce(epoch_us(created_at), -1) as created_us from audit_events union all
        select m + row_number() over (order by uploaded_at, id), username, 'UPLOAD', filename, case when size_bytes is null then '{}' else '{"size_bytes":' || size_bytes || '}' end, epoch_us(uploaded_at) from f, m""",
    "history_append": f"""with f as (select distinct * from query_history where username = '{HOT_USER}' and created_at is not null), m as (select max(id) as m from query_history)
        select id, username, question, coalesce(answer, '') as answer, coalesce(len(sources), -1)::int as n_sources from query_history union all
        select m + row_number() over (order by created_at, id), username, question, '', 0 from f, m""",
    "iso_times": """select distinct id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(created_at) % 1000000 <> 0 then '.' || lpad((epoch_us(created_at) % 1000000)::varchar, 6, '0') else '' end || '+00:00' as iso, epoch_us(created_at) as us
        from audit_events where created_at is not null""",
    "metadata_merge": """with a as (select distinct id, event_type, resource_type, case when json_valid(metadata) then metadata ->> '$.scope' end as scope from audit_events)
        select distinct id, coalesce(scope, '-') as scope, coalesce(event_type, 'unknown') as event, coalesce(resource_type, '-') as resource, ((scope is not null)::int + 1 + (resource_type is not null)::int)::int as n_keys from a""",
    "registered_users": f"""select username, role, coalesce(failed_attempts, -1) as failed_attempts from users union all select 'Admin', 'user', 0 union all
        select distinct 'new.' || lower({_strip('username')}), 'user', 0 from query_history where username is not null and 'new.' || lower({_strip('username')}) not in (select username from users)""",
}
