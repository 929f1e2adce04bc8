"""Queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.tables import table

from . import attention_mil, cube_mixing, line_spread, lp_packing, metric_join, mpeg_audio, periodic_runs, suffix_repetition, trie_lm, unigram_langid, url_filter, weighted_lloyd, zip_warc
from ._common import WORD_PATTERN

#: Places of the public vocabularies.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as an MPEG audio stream in a media column, read back and probed."""
    media = mpeg_audio.store(table(spark, sf_dir, "documents"), "text", keep=("doc_id",))
    return mpeg_audio.probe(media, keep=("doc_id",))


#: The rules of the URL filter's query, and its listed sites (each under three top-level domains).
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
LISTED_URLS = [f"{site}.example.{top}/" for site in LISTED_SITES for top in ("com", "net", "org")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the listed canonical URLs."""
    listed = spark.createDataFrame([(u,) for u in LISTED_URLS], "url string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed, URL_RULES)


ORACLES["op3_url_filter"] = f"""
WITH named AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM named)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), '^(.*[.])?({"|".join(LISTED_SITES)})[.]example[.](com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text judged by its base figures and by its maximal repeats."""
    judged = suffix_repetition.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


@query
def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words by source weights."""
    mixed = cube_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op5_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    packed = lp_packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = unigram_langid.fit(docs.where(~unigram_langid.held_out(F.col("doc_id"))), PIECE_VOCABULARY)
    found = unigram_langid.identify(docs, model)
    return found.select("doc_id", unigram_langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op1_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record in ZIP packages, then read back by ranges."""
    manifest = zip_warc.write_packages(table(spark, sf_dir, "pages"))
    return zip_warc.read_packages(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_zip_warc"] = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, p, sha1(p) AS x, min(page_id) OVER (PARTITION BY p) AS f FROM h),
b AS (SELECT page_id, strlen(p) AS n, f, array_to_string(list_transform(range(40), lambda i: substr(
  '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(x, (i + 1)::INT, 1)) - 1)::INT + 1, 4)), '') AS bits FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT
    + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM b
"""


#: A quarter of the tables' twenty sources.
LEAST_SITES = 5


@query
def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on five sources or more."""
    cleaned = line_spread.dedup(table(spark, sf_dir, "documents"), LEAST_SITES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), line_spread.digest(F.col("text")).alias("kept_md5"))


ORACLES["op7_line_spread"] = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT line, min((doc_id, pos)) AS f FROM w GROUP BY line HAVING count(DISTINCT source) >= {LEAST_SITES}),
h AS (SELECT w.doc_id, list(w.pos) AS cuts FROM w JOIN b USING (line) WHERE (w.doc_id, w.pos) <> b.f GROUP BY w.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id),
k AS (SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(len(h.cuts), 0) AS n_removed,
  CASE WHEN h.cuts IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(d.ls) + 1), lambda i: NOT list_contains(h.cuts, i)), lambda i: d.ls[i]), chr(10)) END AS t
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, n_lines, n_removed, length(t) AS kept_chars, md5(t) AS kept_md5 FROM k
"""


@query
def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 4-word shingles at a Jaccard similarity of 85% or more."""
    return metric_join.classify(table(spark, sf_dir, "documents"))


@query
def op9_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts scored by the unigram base and by the trie model of the training texts."""
    return trie_lm.score(table(spark, sf_dir, "documents"))


@query
def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole embeddings of 64 components in 16 clusters, after three rounds over distinct vectors."""
    found = weighted_lloyd.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", weighted_lloyd.centroid_digest(F.col("centroid"))).drop("centroid")


def _lloyd_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min((d, c)) AS b FROM (SELECT v.r, c.c, {apart} AS d FROM v, c{i} c) v GROUP BY v.r)")
        if i < rounds:
            # s - ((s % n + n) % n) is the multiple of n at or below s.
            parts.append(
                f"""m{i} AS (SELECT c, list(floored ORDER BY p) AS q FROM (
    SELECT a.b[2] AS c, p, ((sum(v.q[p]) - ((sum(v.q[p]) % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS floored
    FROM v JOIN a{i} a USING (r), range(1, {dims + 1}) AS t(p) GROUP BY ALL) GROUP BY c)"""
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (c))")
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT v.vec_id, a.b[2]::INT AS cluster, a.b[1]::BIGINT AS distance, (sum(a.b[1]) OVER (PARTITION BY a.b[2]))::BIGINT AS cluster_inertia,
  (sum(a.b[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.b[2]"""


ORACLES["op11_weighted_lloyd"] = _lloyd_sql()


@query
def op12_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learnt from the labels of documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = attention_mil.fit(docs, labels.where(~attention_mil.held_out(F.col("doc_id"))))
    scored = attention_mil.score(docs, model)
    return scored.select("doc_id", attention_mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def periodic_tail(text: Column, key: Column) -> Column:
    """A tenth of the texts, by their key's checksum, with the words from one of them on made periodic."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # Ten periods reach past the end.
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), 10)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every whole text, a tenth of them with a periodic tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.listing(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
