"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fixity, ftrl, hpylm, kdtree, pivotgrams, setsketch, sizejoin, slackpack, template, tokenalign, urlmodel, weakrules, wumanber
from tidemark.llm.common import cut_lineage, documents, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARDS = 16


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    QUERIES[fn.__name__] = run
    return run


def word_tokenizer() -> str:
    """Path of the public word tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def align_models() -> tokenalign.Tokenizers:
    """Paths of the two public tokenizers that are aligned."""
    import public_tokenizers

    return tokenalign.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as records of one archive, audited against a replica in which every 97th record is damaged and every 89th lost."""
    pages = documents(spark, folder, "pages", "page_id", "url", "html")
    damaged = F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat(F.lit("x"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    copy = F.sha2(fixity.warc_record(F.col("page_id"), F.col("url"), damaged), 256)
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    both = pages.select("page_id", F.length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), copy.alias("copy"))
    placed = cut_lineage(fixity.with_offsets(both))
    replica = placed.where(F.pmod("page_id", F.lit(89)) != 7).select("offset", "length", F.col("copy").alias("digest"))
    found = fixity.audit(placed.select("offset", "length", "digest"), replica)
    return placed.join(found, "offset", "left").select(
        "page_id", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status")
    )


_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'"
    " || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10)"
    " || chr(13) || chr(10) || {body} || chr(13) || chr(10) || chr(13) || chr(10)"
)
ORACLE["op1_merkle_fixity"] = f"""
WITH r AS (
  SELECT page_id, {_RECORD.format(body="html")} AS record, CASE WHEN page_id % 97 = 5 THEN 'x' || substring(html, 2) ELSE html END AS damaged, url
  FROM pages
), d AS (
  SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, sha256({_RECORD.format(body="damaged")}) AS copy FROM r
)
SELECT page_id, CAST(coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, digest, CASE WHEN page_id % 89 = 7 THEN 'missing' WHEN copy <> digest THEN 'corrupt' ELSE 'ok' END AS status
FROM d
"""


@query
def op2_template_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return template.main_text(documents(spark, folder, "pages", "page_id", "url", "html"))


@query
def op3_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document, and the contamination verdict."""
    return wumanber.verdicts(
        wumanber.search(documents(spark, folder, "documents", "doc_id", "text"), documents(spark, folder, "benchmark", "item_id", "text"))
    )


#: Shingle sets, all pairs with a common shingle, and the smallest id in reach of each row, for shingles of {width} words.
_COMPONENTS = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT r, hash(array_to_string(list_slice(ws, p, p + least({width}, len(ws)) - 1), ' ')) AS g
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {less}, 1) + 1)) AS p FROM d WHERE len(ws) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
many AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT s.r, s.g FROM s JOIN many USING (g)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM k a JOIN k b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(doc_id) AS low FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, low) AS component_id{more}
FROM d LEFT JOIN n USING (r) LEFT JOIN least_of ON least_of.a = d.r
"""
ORACLE["op9_setsketch"] = _COMPONENTS.format(width=3, less=2, more=", doc_id = least(doc_id, low) AS kept")
ORACLE["op12_size_aware_join"] = _COMPONENTS.format(width=4, less=3, more="")

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE["op3_wu_manber"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
pats AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, list_slice(ws, p, p + least(13, len(ws)) - 1) AS pat
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
),
lens AS (SELECT DISTINCT n FROM pats),
wins AS (
  SELECT doc_id, n, p, list_slice(ws, p, p + n - 1) AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)
),
hits AS (SELECT doc_id, p, wins.n AS n, item FROM wins JOIN pats ON wins.n = pats.n AND wins.win = pats.pat),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query
def op4_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    docs = documents(spark, folder, "documents", "doc_id", "text", "lang", "source")
    return kdtree.kd_shards(docs, shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op5_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, folder, "documents", "doc_id", "text")
    return ftrl.classify(docs, ftrl.train(docs, documents(spark, folder, "labels", "doc_id", "quality")))


@query
def op6_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document."""
    return hpylm.language_model_scores(documents(spark, folder, "documents", "doc_id", "text"))


@query
def op7_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return slackpack.packed_documents(documents(spark, folder, "documents", "doc_id", "text"), word_tokenizer())


@query
def op8_weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of every document and the label model's verdict."""
    docs = documents(spark, folder, "documents", "doc_id", "text")
    counts = cut_lineage(weakrules.counted(docs))
    judged = weakrules.judge(counts, weakrules.learn(counts))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op9_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return setsketch.near_duplicates(documents(spark, folder, "documents", "doc_id", "text"), setsketch.SketchRule(width=3, least=85, of=100))


@query
def op10_url_model(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = documents(spark, folder, "pages", "page_id", "url")
    return urlmodel.judge(pages, urlmodel.fit(urlmodel.labelled_urls(pages)))


@query
def op11_pivot_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents, their near words and spelling groups."""
    return pivotgrams.spelling_groups(documents(spark, folder, "documents", "doc_id", "text"))


@query
def op12_size_aware_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents: four-word shingles, similarity of 0.85 or more."""
    return sizejoin.set_join(documents(spark, folder, "documents", "doc_id", "text"), sizejoin.JoinRule(width=4, least=85, of=100))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by two tokenizers, grouped at common ends, and the corpus-wide counts of its links."""
    return tokenalign.align(documents(spark, folder, "documents", "doc_id", "text"), align_models())
