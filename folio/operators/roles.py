"""Semantic roles of blocks: neighbours, gates, generation policy, sections, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import text as T

# Label groups, roles and thresholds.
HEADINGS = ("document_title", "section_heading", "subheading", "section_heading_or_panel_title")
EVIDENCE = ("table", "chart", "image")
TEXTUAL = ("document_title", "section_heading", "subheading", "paragraph", "paragraph_or_meta", "section_heading_or_panel_title", "caption_or_panel_title")
RELATIONS = (("previous_text", 2), ("next_text", 2), ("nearest_heading", 1), ("nearest_evidence", 2))
MOST_NEIGHBOURS = 6
QUALITY, ACCEPT, GENERIC_ONLY = 0.55, 0.75, 0.55
DOMAINS = {
    "main_title": ("report_title",),
    "section_heading": ("key_data_box", "consensus_box", "price_chart_block", "thesis_heading"),
    "summary": ("investment_opinion_box",),
    "body": ("supporting_argument",),
    "evidence": ("key_data_box", "consensus_box", "price_chart_block", "financial_table_block", "unsupported_evidence"),
    "metadata": ("report_header_meta", "research_center_meta"),
    "author_info": ("analyst_info",),
    "disclaimer": ("disclaimer_block",),
    "unknown": (),
}
PARENTS = {
    "main_title": "document_structure", "section_heading": "document_structure", "summary": "summary_panel", "body": "narrative", "evidence": "evidence_cluster",
    "metadata": "metadata", "author_info": "metadata", "disclaimer": "compliance",
}
NAMES = {
    "main_title": "document_title_block", "section_heading": "section_heading_block", "summary": "summary_block", "body": "narrative_block", "evidence": "evidence_block",
    "metadata": "metadata_block", "author_info": "author_information_block", "disclaimer": "disclaimer_block", "unknown": "unknown_block",
}
PANELS, TABLES = ("key_data_box", "consensus_box", "price_chart_block"), ("financial_table_block", "unsupported_evidence")
PEOPLE = ("report_header_meta", "research_center_meta", "analyst_info")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def neighbours(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block_id, relation, neighbour, score, place: up to six neighbours of every block.

    Pages are small, so a page's blocks are paired within the page only; a
    block that several relations name stays under the first of them.
    """
    zone = G.zones(F.col("n1"), F.col("n2"), F.col("n3"), F.col("n4"))
    base = blocks.select(
        "doc_id", "page", "block_id", "reading_order", "label", (F.length("text") > 0).alias("filled"), F.get(zone, F.lit(0)).alias("zone"), G.centre(F.col("n1"), F.col("n3")).alias("cx"), G.centre(F.col("n2"), F.col("n4")).alias("cy")
    )
    other = base.select("doc_id", "page", *(F.col(c).alias(f"o_{c}") for c in base.columns[2:]))
    pairs = base.join(other, ["doc_id", "page"]).where("block_id <> o_block_id")
    c = F.col
    gap = F.abs(c("reading_order") - c("o_reading_order"))
    score = 0.6 * F.least(gap / 10, F.lit(1.0)) + 0.4 * G.centre_distance(c("cx"), c("cy"), c("o_cx"), c("o_cy")) + F.when(c("zone") == c("o_zone"), -0.3).otherwise(0.0)
    text = c("o_label").isin(*TEXTUAL) & c("o_filled")
    tests = {
        "previous_text": text & (c("o_reading_order") < c("reading_order")),
        "next_text": text & (c("o_reading_order") > c("reading_order")),
        "nearest_heading": c("o_label").isin(*HEADINGS) & c("o_filled"),
        "nearest_evidence": c("o_label").isin(*EVIDENCE),
    }
    kinds = F.filter(F.array(*(F.when(tests[name], F.struct(F.lit(i).alias("at"), F.lit(name).alias("relation"), F.lit(most).alias("most"))) for i, (name, most) in enumerate(RELATIONS))), lambda k: k.isNotNull())
    rows = pairs.select("doc_id", "page", "block_id", c("o_block_id").alias("neighbour"), c("o_reading_order").alias("o"), gap.alias("gap"), F.round(score, 9).alias("score"), F.explode(kinds).alias("kind"))
    nearest = Window.partitionBy("doc_id", "page", "block_id", "kind.at").orderBy("score", "gap", "o")
    ranked = rows.withColumn("rank", F.row_number().over(nearest)).where("rank <= kind.most")
    first = ranked.withColumn("seen", F.row_number().over(Window.partitionBy("doc_id", "page", "block_id", "neighbour").orderBy("kind.at"))).where("seen = 1")
    place = F.row_number().over(Window.partitionBy("doc_id", "page", "block_id").orderBy("kind.at", "rank"))
    return first.withColumn("place", place).where(c("place") <= MOST_NEIGHBOURS).select("doc_id", "page", "block_id", c("kind.relation").alias("relation"), "neighbour", "score", "place")


def valid_pair(generic: Column, domain: Column) -> Column:
    """A generic role with a domain role that it allows, or with none."""
    ok = domain.isNull()
    for name, allowed in DOMAINS.items():
        ok = ok | (generic == name) & domain.isin(*allowed) if allowed else ok
    return F.coalesce(ok, F.lit(False))


def gate(decisions: DataFrame) -> DataFrame:
    """Accept, trim or refuse each proposed role.

    Rows have quality (of the page), eligible, error (of the model, or null),
    generic_role, domain_role and confidence.  The outcome is a source (model
    or fallback), a reason for a fallback, the roles kept, and needs_review.
    """
    c = F.col
    reason = (
        F.when(~c("eligible"), "ineligible_block")
        .when(c("quality") < QUALITY, "low_page_quality")
        .when(c("error").isNotNull(), c("error"))
        .when(~F.coalesce(c("generic_role").isin(*DOMAINS), F.lit(False)), "schema_mismatch")
        .when(c("confidence") < GENERIC_ONLY, "low_role_confidence")
    )
    rows = decisions.withColumn("fallback_reason", reason)
    accepted = c("fallback_reason").isNull()
    trusted = c("confidence") >= ACCEPT
    domain = F.when(accepted & trusted & valid_pair(c("generic_role"), c("domain_role")), c("domain_role"))
    attempted = c("eligible") & (c("quality") >= QUALITY)
    return rows.select(
        *(x for x in decisions.columns if x not in ("generic_role", "domain_role", "confidence")),
        F.when(accepted, "model").otherwise("fallback").alias("source"), "fallback_reason", F.when(accepted, c("generic_role")).otherwise("unknown").alias("generic_role"), domain.alias("domain_role"),
        F.when(accepted, F.round(c("confidence"), 4)).otherwise(0.0).alias("confidence"), (~accepted | ~trusted).alias("needs_review"), attempted.alias("attempted"),
    )


def policy(generic: Column, domain: Column, purpose: Column) -> tuple[Column, Column]:
    """used_for_generation and section_purpose; the domain role decides before the generic one."""
    none = F.lit(None).cast("string")
    panel = domain.isin(*PANELS)
    used = F.coalesce(
        F.when(domain.isin("report_title", "thesis_heading", "supporting_argument", "investment_opinion_box", "disclaimer_block", *PEOPLE), True).when(panel, generic == "section_heading").when(domain.isin(*TABLES), False),
        generic.isin("author_info", "disclaimer", "summary", "body", "main_title", "section_heading"),
        F.lit(False),
    )
    by_domain = {"report_title": "main_argument", "thesis_heading": "thesis", "supporting_argument": "supporting_argument", "investment_opinion_box": "investment_summary", "disclaimer_block": "disclaimer", **dict.fromkeys(PANELS + TABLES, "evidence_panel")}
    by_generic = {"disclaimer": "disclaimer", "body": "supporting_argument", "main_title": "main_argument"}
    found = (
        F.when(domain.isin(*PEOPLE), none)
        .when(domain.isin(*by_domain), _lookup(by_domain, domain))
        .when(generic.isin("metadata", "author_info"), none)
        .when(generic.isin(*by_generic), _lookup(by_generic, generic))
        .when(generic == "summary", F.coalesce(F.nullif(purpose, F.lit("")), F.lit("investment_summary")))
        .when(generic == "evidence", F.coalesce(F.nullif(purpose, F.lit("")), F.lit("evidence_panel")))
        .otherwise(purpose)
    )
    return used, found


def enrich(generic: Column, domain: Column, name: Column, parent: Column, level: Column) -> tuple[Column, Column, Column]:
    """Name, parent and level of a generated role, with defaults by role."""
    return (
        F.coalesce(T.role_name(name), domain, _lookup(NAMES, generic), F.lit("unknown_block")),
        F.coalesce(T.role_name(parent), _lookup(PARENTS, generic)),
        F.coalesce(F.nullif(F.lower(F.trim(level)), F.lit("")), F.lit("block")),
    )


def section_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block_id, section_id, orphan: headings open sections, arguments join the page's open one."""
    start = F.coalesce(F.col("domain_role").isin("report_title", "thesis_heading"), F.lit(False))
    argument = F.coalesce(F.col("domain_role") == "supporting_argument", F.lit(False))
    so_far = lambda *by: Window.partitionBy(*by).orderBy("page", "reading_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("start", start).withColumn("argument", argument).withColumn("n", F.sum(F.col("start").cast("int")).over(so_far("doc_id"))).withColumn("open", F.max("start").over(so_far("doc_id", "page")))
    named = F.when(F.col("start") | F.col("argument") & F.col("open"), F.concat(F.lit("sec-"), F.lpad(F.col("n").cast("string"), 3, "0")))
    return rows.select("doc_id", "page", "block_id", named.alias("section_id"), (F.col("argument") & ~F.col("open")).alias("orphan"))


def summary(gated: DataFrame) -> DataFrame:
    """One row: attempted, accepted, fallbacks among eligible blocks, reviews, mean accepted confidence."""
    accepted = F.col("source") == "model"
    return gated.agg(
        F.count_if("attempted").alias("attempted"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted & F.col("eligible")).alias("fallbacks"), F.count_if("needs_review").alias("needs_review"),
        F.round(F.coalesce(F.avg(F.when(accepted, F.col("confidence"))), F.lit(0.0)), 4).alias("mean_confidence"),
    )


def breakdown(rows: DataFrame, key: str) -> DataFrame:
    """key, n, share (% of all, one place), by falling n, then key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.greatest("total", F.lit(1)), 1).alias("share")).orderBy(F.desc("n"), key)


LEVELS = ("document", "section", "block")
DECISION = "block_id string, generic_role string, domain_role string, role_confidence double, section_purpose string, reason string, generated_role_name string, generated_role_level string"
DECISION_KEYS = tuple(x.split()[0] for x in DECISION.split(", ")) + ("generated_role_description", "generated_parent_role_name", "used_for_generation", "needs_review")


def parse_decision(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """A model's answer about a block as columns, and ``error``: invalid_json, schema_mismatch or null.

    Unknown keys, unknown roles or levels, a confidence outside 0 to 1 and an
    answer about another block don't match the schema.
    """
    from folio.functions import markup as M

    text = M.json_text(F.col(answer))
    rows = rows.withColumn("__json", text).withColumn("d", F.from_json("__json", DECISION))
    d, keys = F.col("d"), F.json_object_keys("__json")
    every = [role for allowed in DOMAINS.values() for role in allowed]
    fits = (
        (F.size(F.array_except(keys, F.array(*map(F.lit, DECISION_KEYS)))) == 0)
        & d["generic_role"].isin(*DOMAINS)
        & (d["domain_role"].isNull() | d["domain_role"].isin(*every))
        & d["role_confidence"].between(0, 1)
        & (d["block_id"] == F.col("block_id"))
        & (d["generated_role_level"].isNull() | F.lower(F.trim(d["generated_role_level"])).isin(*LEVELS))
    )
    error = F.when(F.col("__json").isNull() | keys.isNull(), "invalid_json").when(~F.coalesce(fits, F.lit(False)), "schema_mismatch")
    known = lambda c: F.when(F.col("error").isNull(), c)
    kept = [c for c in rows.columns if c not in ("__json", "d", answer)]
    return rows.withColumn("error", error).select(
        *kept, "error", known(d["generic_role"]).alias("generic_role"), known(d["domain_role"]).alias("domain_role"), known(F.round(d["role_confidence"], 4)).alias("confidence"),
        known(F.nullif(F.trim(d["section_purpose"]), F.lit(""))).alias("section_purpose"), known(F.split(F.trim(d["reason"]), "\n")[0]).alias("reason"),
    )


def context(blocks: DataFrame) -> DataFrame:
    """doc_id, page, block_id, payload: what a model is told about a block, as JSON with its neighbours in order."""
    zone = G.zones(F.col("n1"), F.col("n2"), F.col("n3"), F.col("n4"))
    near = neighbours(blocks)
    texts = blocks.select("doc_id", "page", F.col("block_id").alias("neighbour"), F.col("label").alias("n_label"), F.col("text").alias("n_text"))
    listed = near.join(texts, ["doc_id", "page", "neighbour"]).groupBy("doc_id", "page", "block_id").agg(F.array_sort(F.collect_list(F.struct("place", "relation", F.col("neighbour").alias("block_id"), F.col("n_label").alias("label"), F.col("n_text").alias("text")))).alias("neighbours"))
    rows = blocks.join(listed, ["doc_id", "page", "block_id"], "left")
    payload = F.to_json(F.struct("block_id", "label", "raw_label", "text", "reading_order", zone.alias("zones"), F.array("n1", "n2", "n3", "n4").alias("bbox"), "neighbours"))
    return rows.select("doc_id", "page", "block_id", payload.alias("payload"))
