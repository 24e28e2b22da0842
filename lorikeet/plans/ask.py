"""The question pipeline over a table of questions, with pluggable models.

route -> rewrite -> embed -> search per collection -> weighted re-rank -> model
re-rank -> prompt -> answer -> parse, as one plan for all questions.  The models
are Column functions; the defaults are deterministic stand-ins that need no
network.  A model that gives null has failed: an unclear route is ``rag``, a failed
rewriting keeps the question, a failed search finds nothing, a failed re-ranking
keeps the order, and a failed answer gives an apology without sources.

Every model is called once per question or chunk: routed questions with their
vectors, the index, the found neighbours and the replies are written tables that
the later steps read, never recomputed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.functions import text as T
from lorikeet.operators.embedding import hashed_vector
from lorikeet.operators.search import MOST_FOUND, PERSONAL, SHARED, WEAK, concatenated, cosine, legacy_collections, scoped_collections, unknown_scope, weighted_rerank
from lorikeet.session import cut_lineage

# Replies and routes that callers read.
NO_MATCH = "No relevant policy content found for this question."
NO_ANSWER = "I apologize, but I encountered an error while generating the answer. Please try rephrasing your question."
NO_REPLY = "I apologize, but I couldn't generate a response. Please try again."
ROUTES = {"direct": "direct_llm", "rag": "rag", "web": "web_scraping", "error": "error"}

WEB_REPLY = "The documents hold no answer, and web search is not enabled."
DIRECT_REPLY = "Please ask a question about your policy documents."

#: Prompts with places for the question and the numbered chunks; any other wording may be given.
RERANK_PROMPT = "Question: {question}\n\nPassages:\n{chunks}\nName the numbers of the five passages that answer the question best, most helpful first, as a comma list and nothing else."
ANSWER_PROMPT = "Passages:\n{chunks}\nQuestion: {question}\n\nAnswer from these passages alone, in the form\nAnswer: ...\nJustification: Referenced from Section: ..."

@dataclass(frozen=True)
class Models:
    """The exchangeable parts; each maps Columns to a Column.

    ``rerank`` and ``answer`` get the filled prompt, the question and the chunks it lists.
    """

    route: Callable[[Column], Column] = T.question_route
    rewrite: Callable[[Column], Column] = T.rewrite_question
    embed: Callable[[Column], Column] = hashed_vector
    rerank: Callable[[Column, Column, Column], Column] = lambda prompt, question, chunks: F.lit("0,1,2,3,4")
    answer: Callable[[Column, Column, Column], Column] = lambda prompt, question, chunks: F.concat(
        F.lit("Answer: "), F.get(chunks, F.lit(0))["text"], F.lit(" Justification: Referenced from Section: "), F.coalesce(F.get(chunks, F.lit(0))["section"], F.lit("General"))
    )
    direct: Callable[[Column], Column] = lambda question: F.lit(DIRECT_REPLY)
    rerank_prompt: str = RERANK_PROMPT
    answer_prompt: str = ANSWER_PROMPT


def index_chunks(chunks: DataFrame, models: Models = Models()) -> DataFrame:
    """Chunks with their text and heading vectors, written; repeated chunk ids count once.

    ``row_id`` is a hash of the chunk id, so it needs no numbering pass.
    """
    rows = chunks.where("chunk_id is not null and text is not null").groupBy("chunk_id", "collection").agg(F.min(F.struct("text", "metadata")).alias("r"))
    name = F.md5(F.concat_ws("|", F.col("chunk_id"), F.coalesce("collection", F.lit(""))))
    rows = rows.select("chunk_id", "collection", "r.text", "r.metadata", F.conv(F.substring(name, 1, 15), 16, 10).cast("bigint").alias("row_id"))
    return cut_lineage(rows.withColumn("vector", models.embed(F.col("text"))).withColumn("heading_vector", models.embed(F.coalesce("metadata.section_heading", F.lit("")))))


_SOURCES = "array<struct<document:string,section:string,text:string>>"
_CHUNK = "struct<new_rank:int,document:string,section:string,text:string,distance:double,position:int>"


def routed(questions: DataFrame, models: Models = Models()) -> DataFrame:
    """The questions with ``route``, ``rewritten`` and, for documents, ``vector``; written."""
    q = questions.withColumn("route", T.normal_route(F.coalesce(models.route(F.col("question")), F.lit("rag"))))
    rag = F.col("route") == "rag"
    q = q.withColumn("rewritten", F.when(rag, T.or_default(models.rewrite(F.col("question")), F.col("question"))))
    return cut_lineage(q.withColumn("vector", F.when(rag, models.embed(F.col("rewritten")))))


def candidates(rag: DataFrame, index: DataFrame, top: int = 15) -> DataFrame:
    """``query_id, cs``: per question its chunks in the order of the weighted score.

    ``rag``: ``query_id, vector, collections``.  What is found is a small share of the
    index: it is sent to the index while its rows are few, and joined beyond.
    """
    found = cut_lineage(concatenated(rag.select("query_id", "vector", "collections"), index.select("row_id", "collection", "vector"), top).join(rag.select("query_id", F.col("vector").alias("qv")), "query_id"))
    n = found.count()
    held = found.select("query_id", "row_id", "position", "distance", "qv")
    rows = index.select("row_id", "text", "metadata", F.col("vector").alias("tv"), "heading_vector")
    scored = rows.join(F.broadcast(held) if n <= MOST_FOUND else held.hint("merge"), "row_id")
    scored = scored.withColumn("text_similarity", F.coalesce(cosine("qv", "tv"), F.lit(0.0))).withColumn("heading_similarity", F.coalesce(cosine("qv", "heading_vector"), F.lit(0.0)))
    ranked = weighted_rerank(scored.withColumn("rank", F.col("position")))
    chunk = F.struct("new_rank", F.col("metadata.document_name").alias("document"), F.col("metadata.section_heading").alias("section"), "text", "distance", "position")
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("cs"))  # at most two lists of ``top``


def answered(r: DataFrame, models: Models = Models(), final: int = 5) -> DataFrame:
    """Adds ``picked`` and ``reply`` to rows with ``rewritten`` and ``cs``; one call of each model, written."""
    n = F.coalesce(F.size("cs"), F.lit(0))
    named = models.rerank(T.fill(models.rerank_prompt, question=F.col("rewritten"), chunks=T.listing(F.col("cs"), 0, "Content")), F.col("rewritten"), F.col("cs"))
    picks = T.parsed_indices(F.coalesce(named, F.lit("")), n.cast("bigint"), final)
    r = r.withColumn("picks", F.when(n > 0, picks))
    picked = F.when(n > 0, F.transform("picks", lambda i: F.get("cs", i.cast("int")))).otherwise(F.array().cast(f"array<{_CHUNK}>"))
    r = cut_lineage(r.withColumn("picked", picked).drop("picks"))
    prompt = T.fill(models.answer_prompt, question=F.col("rewritten"), chunks=T.listing(F.col("picked"), 1, "Text"))
    return cut_lineage(r.withColumn("reply", F.when(F.size("picked") > 0, models.answer(prompt, F.col("rewritten"), F.col("picked")))))


def ask(questions: DataFrame, index: DataFrame, models: Models = Models(), top: int = 15, final: int = 5, web: bool = False, legacy: bool = False, shared: str = SHARED, personal: str = PERSONAL) -> DataFrame:
    """One row per question: ``query_id, response, justification, sources, route_taken,
    rewritten_query, success, needs_web_scraping, metadata, error``.

    ``questions``: ``query_id, question, scope, username, collection`` with unique ids;
    ``shared`` and ``personal`` name the collections of a scope.  ``metadata`` holds
    ``classified_route``, ``top_chunk_distance``, and of the answer ``n_chunks`` and
    ``original_query``, which is the rewritten one.  With ``web``, questions without a
    near chunk take the web route.  With ``legacy``
    nothing is classified, scopes are dispatched without a look at the user, and an
    unknown scope is an error row.
    """
    if legacy:
        models = Models(**{**models.__dict__, "route": lambda question: F.lit("rag")})
    q = routed(questions, models)
    error = unknown_scope(F.col("scope")) if legacy else F.lit(None).cast("string")
    where = legacy_collections(F.col("scope"), F.col("username"), shared, personal) if legacy else scoped_collections(F.col("collection"), F.col("scope"), F.col("username"), shared, personal)
    rag = q.where("route = 'rag'").withColumn("scope_error", error).withColumn("collections", where)
    lists = candidates(rag.where("collections is not null"), index, top)
    r = answered(rag.select("query_id", "route", "rewritten", "scope_error").join(lists, "query_id", "left"), models, final)
    first = F.get(F.filter("cs", lambda c: c["position"] == 0), F.lit(0))["distance"]
    none = F.size("picked") == 0
    failed = ~none & F.col("reply").isNull()
    weak = ~none & (F.coalesce(first, F.lit(2.0)) > WEAK)
    null = F.lit(None).cast("string")
    meta = lambda d, n: F.struct(F.col("route").alias("classified_route"), d.alias("top_chunk_distance"), n.alias("n_chunks"), F.when(n > 0, F.col("rewritten")).alias("original_query"))
    shown = F.transform("picked", lambda c: F.struct(c["document"].alias("document"), c["section"].alias("section"), T.preview(c["text"]).alias("text")))
    rag_out = r.select(
        "query_id",
        F.when(F.col("scope_error").isNotNull(), null).when(none, NO_MATCH).when(failed, NO_ANSWER).otherwise(T.parsed_answer("reply")).alias("response"),
        F.when(~none & ~failed, T.parsed_justification("reply")).alias("justification"),
        F.when(failed, F.array().cast(_SOURCES)).otherwise(shown).alias("sources"),
        F.when(F.col("scope_error").isNotNull(), ROUTES["error"]).otherwise(ROUTES["rag"]).alias("route_taken"),
        F.when(F.col("scope_error").isNull(), F.col("rewritten")).alias("rewritten_query"),
        F.col("scope_error").isNull().alias("success"),
        weak.alias("needs_web_scraping"),
        meta(F.when(~none, F.coalesce(first, F.lit(2.0))), F.size("picked")).alias("metadata"),
        F.col("scope_error").alias("error"),
    )
    if web:
        rag_out = taking_web_route(rag_out)
    reply = cut_lineage(q.where("route <> 'rag'").select("query_id", "route", "rewritten", models.direct(F.col("question")).alias("reply")))
    direct = reply.select(
        "query_id", F.coalesce("reply", F.lit(NO_REPLY)).alias("response"), null.alias("justification"), F.array().cast(_SOURCES).alias("sources"), F.lit(ROUTES["direct"]).alias("route_taken"),
        null.alias("rewritten_query"), F.col("reply").isNotNull().alias("success"), F.lit(False).alias("needs_web_scraping"), meta(F.lit(None).cast("double"), F.lit(0)).alias("metadata"),
        null.alias("error"),
    )
    return rag_out.unionByName(direct)


def threshold_route(needs_web: Column | str) -> Column:
    """``web_scrape`` where a question found no near chunk, else ``proceed``."""
    return F.when(F.coalesce(needs_web, F.lit(False)), "web_scrape").otherwise("proceed")


def taking_web_route(results: DataFrame) -> DataFrame:
    """Results of ``ask`` in which the flagged questions got the placeholder of the web route."""
    web = threshold_route("needs_web_scraping") == "web_scrape"
    new = {"response": F.lit(WEB_REPLY), "justification": F.lit(None).cast("string"), "sources": F.array().cast(_SOURCES), "route_taken": F.lit(ROUTES["web"]), "success": F.lit(False)}
    return results.select(*(F.when(web, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in results.columns))


def web_answers(questions: DataFrame) -> DataFrame:
    """Placeholder rows of the web route: no sources, not successful."""
    return questions.select("query_id", F.lit(ROUTES["web"]).alias("route_taken"), F.lit(WEB_REPLY).alias("response"), F.lit(False).alias("success"))
