"""The named queries of the engine and, in ``oracles``, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import markup as M
from folio.functions import text as T
from folio.operators import blocks as B
from folio.operators import catalog as C
from folio.operators import evidence as E
from folio.operators import ingest as I
from folio.operators import layout as L
from folio.operators import roles as R
from folio.operators import search as S
from folio.operators import style as Y
from folio.sources import files
from folio.streaming import trace as X
from folio.shared import few, staged
from folio.tables import table

from . import images, stores
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = images.QUERIES | stores.QUERIES
ORACLES |= images.ORACLES | stores.ORACLES

#: The model's answer for conversations whose id is divisible by 100; the other ones that ask get no JSON.
EXPANSION = '{"entities": ["andonhethnt"], "semantic_queries": ["nation of things"], "lexical_queries": ["thing eronin"]}'


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.derived(documents(spark, sf_dir))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.canonical(raw_blocks(spark, sf_dir))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify_pages(L.page_metrics(canonical(spark, sf_dir)))


def semantic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a semantic run over documents of even ids: roles by arithmetic, and every tenth page left out."""
    at = F.col("doc_id") + F.col("page") + F.col("block_index")
    rows = raw_blocks(spark, sf_dir).where("doc_id % 2 = 0 AND (doc_id + page) % 10 <> 0")
    return rows.select(
        "doc_id", "page", "block_index", F.col("content").alias("text"), F.when(at % 3 == 0, "body").when(at % 3 == 1, "evidence").alias("generic_role"), F.when(at % 5 == 0, "key_data_box").alias("domain_role"),
        F.lit(None).cast("string").alias("generated_role_name"), F.when(at % 3 == 0, "thesis").otherwise("").alias("section_purpose"), ((at % 11) / 10.0).alias("role_confidence"), (at % 4 == 0).alias("needs_review"),
    )


def records(spark: SparkSession, sf_dir: str, display: bool = True) -> DataFrame:
    """Search records of all indexable blocks: semantic where there is a semantic page, else parsed."""
    blocks, semantic = raw_blocks(spark, sf_dir), semantic_blocks(spark, sf_dir)
    pages = staged(semantic.select("doc_id", "page").distinct().withColumn("is_semantic", F.lit(True)), "semantic-pages")
    return S.build_records(pages, blocks, semantic, display)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search queries ask: the first turn of every conversation whose id is divisible by 50."""
    asked = table(spark, sf_dir, "conversations").where("conv_id % 50 = 0 AND turn = 0")
    return asked.groupBy("conv_id").agg(F.min("text").alias("query")).select(F.concat(F.lit("q"), "conv_id").alias("query_id"), "query", "conv_id")


# --- search ------------------------------------------------------------------


@query
def tokenize_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct"))


@query
def query_profile(spark, sf_dir):
    p = S.profile(questions(spark, sf_dir))
    return p.select("query_id", "normalized", F.array_join("query_tokens", "|").alias("query_tokens"), F.array_join("entities", "|").alias("entities"), F.array_join("lexical_queries", "|").alias("lexical_queries"))


@query
def search_records(spark, sf_dir):
    rows = records(spark, sf_dir)
    text = F.col("embedding_text")
    return rows.select("record_id", "source_kind", F.round("role_confidence", 6).alias("role_confidence"), "needs_review", F.length("display").cast("long").alias("display_chars"), F.length(text).cast("long").alias("embedding_chars"), F.md5(text).alias("embedding_md5"))


@query
def search_metadata(spark, sf_dir):
    return S.metadata(records(spark, sf_dir)).select("record_id", "page", "display_block_id", *S.ROLES, "semantic_needs_review", "source_kind")


@query
def bm25_docfreq(spark, sf_dir):
    return S.postings(records(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "record_id", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_topk(spark, sf_dir):
    return _hits(S.bm25(records(spark, sf_dir, display=False), questions(spark, sf_dir).where("query_id = 'q0'")))


@query
def bm25_multi_query(spark, sf_dir):
    return _hits(S.bm25(records(spark, sf_dir, display=False), questions(spark, sf_dir)))


@query
def bm25_doc_filter(spark, sf_dir):
    return _hits(S.bm25(records(spark, sf_dir, display=False), questions(spark, sf_dir), doc_ids=list(range(0, 40))))


def entity_rows(spark: SparkSession, sf_dir: str, part: int = 50) -> DataFrame:
    """Entities of benchmark items whose id is divisible by ``part``: all their words, which are common, rare or nowhere."""
    items = table(spark, sf_dir, "benchmark").where(F.col("item_id") % part == 0)
    return items.select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.explode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("entity")).distinct()


@query
def entity_grounding(spark, sf_dir):
    return S.ground_entities(records(spark, sf_dir), entity_rows(spark, sf_dir)).select("query_id", "entity", "match_count", six("match_ratio"), "factor", "is_common")


@query
def entity_scores(spark, sf_dir):
    return S.entity_scores(records(spark, sf_dir), entity_rows(spark, sf_dir))


@query
def entity_dictionary(spark, sf_dir):
    """All words of all benchmark items as one automaton over all records: how many records hold each."""
    words = entity_rows(spark, sf_dir, 1).select(F.lower("entity").alias("word"))
    lowered = records(spark, sf_dir).select("record_id", F.lower("text").alias("text"))
    return S.contained(lowered, words).groupBy("word").agg(F.count("*").alias("n"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of the first block of the document of that id."""
    kind = F.when((F.col("vec_id") % 2 == 0) & ((F.col("vec_id") + 1) % 10 != 0), "semantic").otherwise("fallback")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(kind, F.lit(":"), F.col("vec_id"), F.lit(":1:1")).alias("record_id"), "embedding")


@query
def knn_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors."""
    rows = vectors(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    found = S.nearest(rows, asked, top=20)
    return found.select("query_id", "record_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("conv_id") % 100 == 0, EXPANSION).otherwise("not-json")
    return S.expand(S.profile(questions(spark, sf_dir)).withColumn("expansion", answer).withColumn("expanded", F.col("conv_id") % 100 == 0))


def _hybrid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    # Only what the search reads is staged.
    rows = records(spark, sf_dir, display=False).select("record_id", "doc_id", "page", "block_id", "text", "role_confidence", "needs_review")
    rows, own = staged(rows, "records"), vectors(spark, sf_dir)
    # The vectors after the conversation's number stand for its semantic queries.
    asked = _profiles(spark, sf_dir).select("query_id", F.posexplode("semantic_queries").alias("nth", "of"), "conv_id").withColumn("vec_id", F.col("conv_id") + F.col("nth"))
    asked = own.join(asked, "vec_id").select("query_id", "nth", F.col("embedding").alias("vector"))
    return S.search(rows, _profiles(spark, sf_dir), own, asked), rows


@query
def search_trace(spark, sf_dir):
    """The events that the hybrid search logs, with the sizes of what they tell."""
    found, _ = _hybrid(spark, sf_dir)
    events = S.trace_events(_profiles(spark, sf_dir), found, {"llm_expansion": ~F.col("expanded")})
    return events.select("query_id", F.col("at").cast("long").alias("at"), "event", F.get_json_object("payload", "$.n").cast("long").alias("n"))


@query
def hybrid_search(spark, sf_dir):
    found, _ = _hybrid(spark, sf_dir)
    return found.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "record_id", F.array_join("channels", ",").alias("channels"), F.round("score", 6).alias("score"), F.round("bm25", 6).alias("bm25"), F.round("distance", 5).alias("distance"), six("entity"), F.array_join("terms", ",").alias("terms")
    )


@query
def search_output(spark, sf_dir):
    found, rows = _hybrid(spark, sf_dir)
    # What is shown is a few rows; the texts don't move to meet them.
    return S.output_line(rows.select("record_id", "text").join(few(staged(found, "found")), "record_id"))


# --- text --------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    clean = T.clean_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("clean_md5"))


@query
def script_buckets(spark, sf_dir):
    names = ("hangul", "latin", "han", "other")
    return documents(spark, sf_dir).select("doc_id", *(c.cast("long").alias(n) for c, n in zip(T.script_counts(F.col("text")), names, strict=True)))


@query
def text_quality(spark, sf_dir):
    rows = B.canonical(raw_blocks(spark, sf_dir), measured=True)
    return rows.select("block_id", "page", *(F.round(f"measures.{c}", 6).alias(n) for c, n in (("weird", "weird"), ("long_tokens", "long_tokens"), ("repeat", "repeat"))), "quality")


@query
def language_detect(spark, sf_dir):
    hangul, latin, han, _ = T.script_counts(F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", T.language_of(hangul, latin, han).alias("language"))


@query
def financial_signal(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy("doc_id").agg(F.count_if(T.financial_signal(F.col("text"))).alias("signals"))


@query
def stable_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.stable_hash(F.col("doc_id").cast("string"), F.col("source")).alias("hash"), T.safe_name(F.concat("source", F.lit(" /"), "lang")).alias("name"), T.role_name(F.concat_ws(" ", "lang", "source")).alias("role"))


@query
def ordered_dedupe(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", T.dedupe_texts(F.split("text", "\n")).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


# --- layout ------------------------------------------------------------------


@query
def canonical_blocks(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", "page", "block_id", "label", "reading_order", "n1", "n2", "n3", "n4", F.length("text").cast("long").alias("chars"))


@query
def page_metrics(spark, sf_dir):
    return L.page_metrics(canonical(spark, sf_dir))


@query
def page_archetype(spark, sf_dir):
    return page_table(spark, sf_dir).select("doc_id", "page", "archetype", "pattern", "warnings", "large_visual")


@query
def page_specs(spark, sf_dir):
    return L.page_specs(page_table(spark, sf_dir))


@query
def doc_family(spark, sf_dir):
    return L.document_family(canonical(spark, sf_dir), page_table(spark, sf_dir))


@query
def section_order(spark, sf_dir):
    return L.section_order(canonical(spark, sf_dir), page_table(spark, sf_dir))


@query
def style_tokens(spark, sf_dir):
    return L.style_tokens(canonical(spark, sf_dir), page_table(spark, sf_dir))


@query
def image_slots(spark, sf_dir):
    return L.image_slots(canonical(spark, sf_dir), page_table(spark, sf_dir))


@query
def unsupported_blocks(spark, sf_dir):
    return L.unsupported_blocks(canonical(spark, sf_dir))


@query
def repeating_elements(spark, sf_dir):
    return L.repeating_elements(canonical(spark, sf_dir), ("text", "paragraph_title", "vision_footnote"))


@query
def review_gate(spark, sf_dir):
    blocks, pages = canonical(spark, sf_dir), page_table(spark, sf_dir)
    return L.review_gate(L.document_family(blocks, pages), pages, L.section_order(blocks, pages))


# --- roles -------------------------------------------------------------------


@query
def zone_tags(spark, sf_dir):
    return canonical(spark, sf_dir).select("block_id", "page", F.array_join(G.zones(*(F.col(f"n{i}") for i in range(1, 5))), ",").alias("zones"), G.alignment(F.col("n1"), F.col("n3")).alias("alignment"))


@query
def neighbor_topk(spark, sf_dir):
    return R.neighbours(canonical(spark, sf_dir)).select("block_id", "relation", "neighbour", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model's answers: a role for each block by arithmetic, wrong ones included."""
    blocks = canonical(spark, sf_dir)
    at = F.col("doc_id") + F.col("reading_order") * 3
    roles = F.array(*map(F.lit, ("main_title", "section_heading", "body", "evidence", "summary", "metadata", "disclaimer", "oddity")))
    domains = F.array(*map(F.lit, ("report_title", "thesis_heading", "supporting_argument", "key_data_box", "report_title")))
    return blocks.select(
        "doc_id", "page", "block_id", "reading_order", "quality", ((F.length("text") > 0) | F.col("label").isin("table", "chart", "image")).alias("eligible"),
        F.when(at % 17 == 0, "backend_error").when(at % 19 == 0, "invalid_json").alias("error"), F.get(roles, (at % 8).cast("int")).alias("generic_role"), F.get(domains, (at % 6).cast("int")).alias("domain_role"), ((at % 101) / 100.0).alias("confidence"),
    )


@query
def role_gate(spark, sf_dir):
    return R.gate(decisions(spark, sf_dir)).select("block_id", "source", "fallback_reason", "generic_role", "domain_role", "confidence", "needs_review", "attempted")


@query
def role_policy(spark, sf_dir):
    gated = R.gate(decisions(spark, sf_dir))
    used, purpose = R.policy(F.col("generic_role"), F.col("domain_role"), F.lit(None).cast("string"))
    name, parent, level = R.enrich(F.col("generic_role"), F.col("domain_role"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return gated.select("block_id", used.alias("used"), purpose.alias("purpose"), name.alias("role_name"), parent.alias("parent"), level.alias("level"))


@query
def section_ids(spark, sf_dir):
    return R.section_ids(R.gate(decisions(spark, sf_dir))).select("block_id", "section_id", "orphan")


@query
def semantic_summary(spark, sf_dir):
    return R.summary(R.gate(decisions(spark, sf_dir)))


@query
def source_breakdown(spark, sf_dir):
    return R.breakdown(documents(spark, sf_dir), "source")


# --- catalog -----------------------------------------------------------------


def catalog_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, page images and files in the catalog's columns, derived from documents and their pages."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("-"), "doc_id").alias("display_name"), (F.col("doc_id") % 4 + 1).cast("int").alias("process_status"))
    pages = raw_blocks(spark, sf_dir).where("block_index = 1 AND doc_id % 7 <> 0").select("doc_id", F.col("page").alias("display_order"), F.concat_ws("/", "doc_id", "page").alias("file_id"))
    return docs, pages, pages.select("file_id", F.lit("image/png").alias("mime_type"))


@query
def document_list(spark, sf_dir):
    docs, images, _ = catalog_tables(spark, sf_dir)
    return C.document_list(docs, images)


@query
def documents_ready(spark, sf_dir):
    docs, _, _ = catalog_tables(spark, sf_dir)
    return C.all_exist(docs, [1, 2, 2]).crossJoin(C.all_ready(docs, [2, 6, 10]))


@query
def page_image_at(spark, sf_dir):
    _, images, files = catalog_tables(spark, sf_dir)
    return C.page_images(images, files).where("page = 1").select("doc_id", "file_id", "mime_type")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.create_map(*(F.lit(x) for pair in C.DEPTHS.items() for x in pair))[F.col("role")]
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), depth.alias("depth"), F.col("text").alias("content_text"))


@query
def chat_detail(spark, sf_dir):
    talk = messages(spark, sf_dir)
    chats = talk.groupBy("chat_id").agg(C.chat_name(F.min_by("content_text", "message_id")).alias("display_name"))
    sources = chats.select("chat_id", F.explode(F.array(F.col("chat_id"), F.col("chat_id") + 1)).alias("doc_id"))
    found = C.chat_detail(chats, sources, talk)
    return found.select("chat_id", "display_name", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"), F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: m["content_text"]), "\n")).alias("messages_md5"))


@query
def message_groups(spark, sf_dir):
    return C.message_groups(messages(spark, sf_dir))


@query
def message_visibility(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("chat_id").agg(F.count_if(F.col("depth") <= C.VISIBLE_DEPTH).alias("visible"), F.count_if(F.col("depth") > C.VISIBLE_DEPTH).alias("hidden"))


@query
def artifact_upsert(spark, sf_dir):
    docs = documents(spark, sf_dir)
    old = docs.select("doc_id", F.lit("ocr").alias("artifact_name"), F.col("n_chars").alias("size"))
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("ocr").alias("artifact_name"), F.lit(0).cast("long").alias("size"))
    return C.upsert(old, new, ["doc_id", "artifact_name"])


@query
def artifact_invalid(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("content_json"))
    valid, invalid = C.split_valid(events, "k int")
    return valid.select("event_id", F.col("parsed.k").cast("long").alias("k"), F.lit(True).alias("valid")).unionByName(invalid.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(False).alias("valid")))


@query
def artifacts_missing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    have = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("ocr").alias("artifact_name"))
    return C.missing(docs, have, ["ocr", "style"])


# --- logs --------------------------------------------------------------------


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "run_started", "purchase": "run_completed", "error": "run_failed"}.items() for x in pair))[F.col("event_type")]
    component = F.when(F.col("event_type") == "view", "search_index").when(F.col("event_type") == "click", "write")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run_id"), F.coalesce(kind, F.col("event_type")).alias("event"), component.alias("component"))


@query
def event_router(spark, sf_dir):
    return X.route(trace(spark, sf_dir)).groupBy("component", "to_search").agg(F.count("*").alias("n"))


@query
def run_status(spark, sf_dir):
    return X.latest(trace(spark, sf_dir)).select("run_id", "event_id", X.status_of(F.col("event")).alias("status"))


@query
def log_tail(spark, sf_dir):
    return X.tail(trace(spark, sf_dir), 3).select("run_id", "event_id", F.col("from_end").cast("long").alias("from_end"))


@query
def step_durations(spark, sf_dir):
    return X.step_durations(trace(spark, sf_dir), "run_started", ("run_completed", "run_failed"))


@query
def status_stream(spark, sf_dir):
    """T5 as a stream over the events file, run until there is nothing more to read."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    events = X.stream(spark, sf_dir, schema, "events.parquet").select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("event"))
    from folio.shared import shared_dir

    return X.drain(X.status_counts(events), f"{shared_dir(spark)}/folio/status-{uuid.uuid4().hex}", "run_id")


# --- markup and evidence -------------------------------------------------------


@query
def html_preview(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.preview(F.col("html")).alias("preview"))


@query
def html_structured(spark, sf_dir):
    """Every page's blocks as structured HTML, by its digest."""
    rows = raw_blocks(spark, sf_dir)
    block_id = F.concat(F.lit("page-"), F.col("page"), F.lit("-block-"), F.col("block_index"))
    html = M.block_html(block_id, F.col("raw_label"), F.col("content"), *(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    pages = rows.select("doc_id", "page", "block_index", html.alias("html")).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "html"))), lambda b: b["html"]).alias("parts"))
    return pages.select("doc_id", "page", F.md5(M.page_html(F.concat(F.lit("page-"), F.col("page")), F.col("parts"))).alias("html_md5"))


@query
def json_extract(spark, sf_dir):
    wrapped = F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", M.json_text(wrapped).alias("json_text"), F.get_json_object(M.json_object(wrapped), "$.k").alias("k"), M.json_object(wrapped, whole=True).alias("whole"))


@query
def document_extract(spark, sf_dir):
    answer = F.concat(F.lit("Answer follows. <page id=\"p\">"), F.col("html"), F.lit("</page> end"))
    full = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x <document id=\"output\">"), answer, F.lit("</document> y"))).otherwise(answer)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.document_block(full)).alias("document_md5"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis answers made of documents: evidence, sources and unsupported blocks as JSON."""
    made = F.concat(
        F.lit('{"query": "q", "source_documents": [{"document_id": "s1", "used": "yes", "reason": " r "}], "evidence": [{"document_id": "'), F.col("source"), F.lit('", "page_id": 1, "block_id": "block-1", "matched_via": "entity"}, {"document_id": "'), F.col("source"),
        F.lit('", "page_id": "x", "block_id": "b2", "matched_via": ["semantic", "bm25", "semantic"]}, {"document_id": "", "block_id": "b3"}], "unsupported_blocks": [{"block_id": "target-page-1-block-11", "support_status": "partially_supported", "required_action": "empty_cells"}, {"block_id": "no", "required_action": "empty_block"}, {"block_id": "output-page-2-block-3", "support_status": "bad", "required_action": "bad"}]}'),
    )
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), made.alias("payload"), F.array(F.lit("s1"), F.lit("s2")).alias("source_ids"))


@query
def evidence_normalize(spark, sf_dir):
    return E.evidence(payloads(spark, sf_dir)).select("id", "document_id", "page_id", "block_id", "matched_via")


@query
def sources_normalize(spark, sf_dir):
    return E.source_documents(payloads(spark, sf_dir)).select("id", "document_id", "used", "reason")


@query
def unsupported_normalize(spark, sf_dir):
    return E.unsupported(payloads(spark, sf_dir)).select("id", "block_id", "support_status", "required_action")


@query
def sanitize_table(spark, sf_dir):
    html = F.concat(F.lit('<div id="page-1-block-1"><table><tr><td>k</td><td>a</td><td>b</td></tr><tr><td>'), F.col("source"), F.lit("</td><td>"), F.col("lang"), F.lit("</td><td>-</td></tr></table></div>"))
    action = F.when(F.col("doc_id") % 2 == 0, "empty_table_values").otherwise("empty_cells")
    rows = documents(spark, sf_dir).select("doc_id", html.alias("html"), action.alias("required_action"), F.array(F.lit("a")).alias("columns"))
    return E.sanitize(rows).select("doc_id", "sanitized", "violates")


# --- style -------------------------------------------------------------------


@query
def line_grouping(spark, sf_dir):
    boxes = raw_blocks(spark, sf_dir).select("doc_id", "page", F.concat_ws("-", F.lit("b"), "block_index").alias("box_id"), "x1", (F.col("y1") / 2).cast("int").alias("y1"), F.col("y2"))
    return Y.group_lines(boxes)


@query
def median_color(spark, sf_dir):
    part = lambda k: (F.floor(F.col("event_id") / k) % 256).cast("int")
    pixels = table(spark, sf_dir, "events").select("event_type", part(1).alias("red"), part(3).alias("green"), part(7).alias("blue"))
    found = Y.median_colour(pixels, "event_type")
    return found.select("event_type", T.color_css(F.col("red"), F.col("green"), F.col("blue")).alias("color"))


@query
def font_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), F.col("l_suppkey")).alias("block_id"), F.col("l_returnflag").alias("font"), F.col("l_quantity").alias("cost"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_tax")).alias("size"))
    return Y.merge_fonts(rows).select("block_id", "font", six("size"))


@query
def edit_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", Y.edit_slice(F.col("text"), F.substring("text", 20, 30)).alias("s")).select("item_id", "s.first", "s.stop")


@query
def edit_slice_altered(spark, sf_dir):
    """A piece of every whole document, some of its letters changed, one left out and one put in, found in the text again."""
    at = 1 + (F.col("doc_id") * 31) % F.greatest(F.lit(1), F.length("text") - 40)
    piece = F.substring("text", at, F.lit(40))
    altered = F.concat(F.translate(F.substring(piece, 1, 15), "eo", "xy"), F.lit("q"), F.substring(piece, 17, 30))
    rows = documents(spark, sf_dir).select("doc_id", Y.edit_slice(F.col("text"), altered).alias("s"), at.alias("at"))
    return rows.select("doc_id", "s.first", "s.stop", F.col("at").cast("long").alias("at"))


@query
def char_align(spark, sf_dir):
    """Boxes of a text's letters, of which every seventh is missing and every fifth has a wrong box that touches its neighbours."""
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("block_id"), "text")
    letters = rows.select("block_id", "text", F.posexplode(F.split("text", "")).alias("pos", "char")).where("char <> ''")
    right = letters.where("pos % 7 <> 3").select("block_id", "text", (F.col("pos") * 10).cast("int").alias("xmin"), (F.col("pos") * 10 + 8).cast("int").alias("xmax"), "char")
    wrong = letters.where("pos % 5 = 2 AND pos % 7 <> 3").select("block_id", "text", (F.col("pos") * 10 - 2).cast("int").alias("xmin"), (F.col("pos") * 10 + 10).cast("int").alias("xmax"), "char")
    return Y.align_characters(right.unionByName(wrong))


# --- agent and writer tools ------------------------------------------------------


@query
def fetch_page(spark, sf_dir):
    """Pages that an agent asks for: one of each document that is there, one behind its end, one of no document."""
    blocks = raw_blocks(spark, sf_dir)
    pages = blocks.groupBy("doc_id", "page").agg(F.concat(F.lit("blocks: "), F.count("*")).alias("html"))
    docs = documents(spark, sf_dir).where("text IS NOT NULL")
    last = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(0), F.lit(100_000))).alias("page")).unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("doc_id"), F.lit(1).alias("page")))
    return C.fetch_page(pages, last).select("doc_id", "page", "answer")


@query
def chat_export(spark, sf_dir):
    _, text = C.export_chat(messages(spark, sf_dir))
    return text.select("chat_id", F.md5("markdown").alias("markdown_md5"))


@query
def role_overlay(spark, sf_dir):
    gated = R.gate(decisions(spark, sf_dir)).withColumn("generic_role", F.nullif("generic_role", F.lit("unknown")))
    return C.overlay(gated).select("block_id", "generic_role", "domain_role", F.col("reading_order").cast("long").alias("reading_order"))


@query
def decision_parse(spark, sf_dir):
    """A model's answers as JSON, of which some are cut off, say too much, or are out of range."""
    at = F.col("doc_id") + F.col("reading_order")
    answer = F.concat(
        F.lit('<think>hm</think>{"block_id": "'), F.col("block_id"), F.lit('", "generic_role": "'), F.when(at % 5 == 0, "oddity").otherwise("body"), F.lit('", "domain_role": "supporting_argument", "role_confidence": '),
        F.when(at % 7 == 0, "1.5").otherwise("0.87654"), F.when(at % 11 == 0, ', "mood": 1').otherwise(""), F.lit(', "reason": " first\\nsecond "'), F.when(at % 13 == 0, "").otherwise("}"),
    )
    rows = canonical(spark, sf_dir).select("block_id", answer.alias("answer"))
    return R.parse_decision(rows).select("block_id", "error", "generic_role", "domain_role", "confidence", "reason")


@query
def output_placement(spark, sf_dir):
    """A writer's HTML: two blocks, of which the first is given twice, and one that holds an image."""
    div = lambda block, text: F.concat(F.lit(f'<div id="output-page-2-block-{block}"><p>'), text, F.lit("</p></div>\n"))
    html = F.concat(div(1, F.lit("old")), div(3, F.col("source")), div(1, F.col("lang")), F.lit('<div id="page-2-block-4"><img src="x"></div>'))
    found = E.placements(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), html.alias("html")))
    return found.select("id", "page", "block", "html")


@query
def rendered_pages(spark, sf_dir):
    """Blocks with HTML as positioned entries: how many a page has, and the first one's style."""
    rows = raw_blocks(spark, sf_dir).withColumn("html", F.when(F.col("raw_label") != "image", F.col("content"))).withColumn("line_count", F.lit(2))
    rows = rows.withColumn("font_family", F.when(F.col("doc_id") % 2 == 0, "Serif")).withColumn("color", F.lit(None).cast("string"))
    entries = F.from_json("json", "array<struct<block_index:int,css:string>>")
    return Y.rendered(rows).select("doc_id", "page", F.size(entries).cast("long").alias("n"), F.get(entries, F.lit(0))["css"].alias("css"))


@query
def chat_rename(spark, sf_dir):
    """Names that chats may be given: not blank, not over 64 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.repeat(F.lit(" "), 3)).otherwise(F.col("text")).alias("name"))
    return rows.select("conv_id", "turn", C.rename_allowed(F.col("name")).alias("allowed"), C.chat_name(F.col("name")).alias("short"))


# --- values, clocks and log rows -----------------------------------------------


def by_id(key: str, *values):
    """One of the texts for each row, by its id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@query
def coercions(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", by_id("doc_id", " Yes ", "1", "no", "2.75", "-3e2", "abc", None).alias("raw"), by_id("doc_id", '[" a ", "", 3, null]', "[]", "none", '{"a": 1}', None).alias("items"), by_id("doc_id", '[1.9, "2", -3.5, 4, 9]', "[1, 2]", '[1, 2, "x", 4]', "1234").alias("box"))
    return rows.select(
        "doc_id", M.as_bool(F.col("raw")).alias("flag"), M.as_int(F.col("raw")).alias("whole"), M.as_float(F.col("raw")).alias("number"),
        F.array_join(M.as_list(F.col("items")), "|").alias("items"), F.array_join(M.as_box(F.col("box")).cast("array<string>"), "|").alias("box"),
    )


@query
def value_format(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "n_chars", F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 5 > 1, F.col("lang")).otherwise("")).alias("word"), (F.col("n_chars") / 7).alias("ratio"), (F.col("n_chars") % 2 == 0).alias("even"))
    rows = rows.withColumn("names", F.when(F.col("doc_id") % 3 > 0, F.array("n_chars", "doc_id")).otherwise(F.array().cast("array<bigint>"))).withColumn("object", F.struct("n_chars"))
    return rows.select("doc_id", *(M.shown(F.col(c), kind).alias(c) for c, kind in rows.dtypes[1:]))


@query
def run_clock(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", X.utc_time(at).alias("time"), X.epoch_seconds(at).alias("seconds"), X.run_name(at).alias("run_id"))


@query
def analysis_normalize(spark, sf_dir):
    payload = by_id("doc_id", '{"query": "  ", "user_intent": " why ", "writing_strategy": [" a ", "", "b"], "uncertainties": "none"}', '{"query": " q ", "uncertainties": [1]}', "not json", None)
    found = E.analysis(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("query"), payload.alias("payload")))
    return found.select("id", "query", "user_intent", F.array_join("writing_strategy", "|").alias("writing_strategy"), F.array_join("uncertainties", "|").alias("uncertainties"))


@query
def trace_records(spark, sf_dir):
    message = by_id("event_id", '{"event": "hit", "component": "search_index", "duration_ms": 1.23456, "n": 3}', '{"type": "step", "event": "", "duration_ms": "x"}', '{"component": "", "k": {"a": [1]}}', "plain text", "[1, 2]")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), message.alias("message"))
    return X.recorded(rows).select("run_id", "time", "component", "event", "duration_ms", "payload", "to_search")


@query
def upload_kinds(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("in.d/"), F.col("source"), by_id("doc_id", ".pdf", ".PNG", ".tar.webp", ".md", ".exe", "")).alias("path"))
    kind, reason = files.classify_upload(F.col("path"))
    return rows.select("doc_id", files.extension(F.col("path")).alias("extension"), kind.alias("kind"), reason.alias("reject_reason"))


@query
def box_centres(spark, sf_dir):
    c = F.col
    rows = documents(spark, sf_dir).select("doc_id", (c("doc_id") % 50).alias("x1"), (c("doc_id") % 70).alias("y1"), (c("doc_id") % 50 + 8).alias("x2"), (c("doc_id") % 70 + 9).alias("y2"), F.lit(64).alias("width"), F.lit(80).alias("height"))
    return I.centre_boxes(rows).select("doc_id", "cx", "cy", "w", "h")


@query
def duration_labels(spark, sf_dir):
    ms = F.when(F.col("doc_id") % 9 > 0, F.col("n_chars") * 10 + 3)
    return documents(spark, sf_dir).select("doc_id", T.duration(ms).alias("label"), C.append_log(F.lit("queued\n"), F.concat(F.lit("  "), F.col("source"), F.lit(" \n"))).alias("log"))


@query
def chat_list(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id")).distinct()
    return C.chat_list(chats.select("chat_id", F.concat(F.lit("chat "), F.col("chat_id")).alias("display_name"), F.when(F.col("chat_id") % 3 == 0, F.col("chat_id")).alias("rendered_file_id")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over all blocks of all documents."""
    return hybrid_search(spark, sf_dir)
