"""The registered queries of this package, each beside the SQL that checks it (None where SQL cannot state it)."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucarne.llm import alignment, bm25, bpe, embedding_dedup, language, maxscore, mixing, ngram_join, pieces, pii, quality, url_filter, warc
from lucarne.llm.shared import Staging, table
from lucarne.session import small_table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def piece_model(name: str = PIECE_MODEL) -> bytes:
    """The bytes of a vocabulary file of the machine; any other path serves as well."""
    return pieces.read_model(importlib.import_module("public_tokenizers").path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.round_trip(docs, piece_model())
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    staging = Staging(spark, "warc")
    archives = staging.keep(warc.write(pages, staging.path()))
    records = warc.read(spark, archives, archives.count(), payloads=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT sha256(payload) AS digest, min(page_id) AS first FROM p WHERE octet_length(payload) >= 100 GROUP BY 1)
SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON sha256(payload) = digest
"""

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under four rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = small_table(spark, URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules).drop("url")


OP5_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
split AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its links at 85 % of 4-word shingles."""
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(sized, F.col("words"), weights=(3.0, 1.0, 2.0), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans counted and digested, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(pii.of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.in_order(F.col("base")), 256).alias("base_sha256"),
        pii.in_order(F.concat("base", "added")).alias("spans"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component at cosine 0.93."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document (declared language and source as evidence) and every page (markup, address and host)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language.train(docs, "text", "lang")
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    host, path = url_filter.split_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", language.page_text(F.col("html")).alias("text"), language.declared_language(F.col("html")).alias("declared"), host.alias("host"), path.alias("path"))
    suffix, domain = language.address_parts(F.col("host"), F.col("path"))
    web = language.identify(pages, model, declared=F.col("declared"), suffix=suffix, host=F.col("host"), domain=domain)
    result = ("language", "probability", F.col("accepted").alias("kept"))
    null = F.lit(None).cast("long")
    return found.select("doc_id", null.alias("page_id"), *result).union(web.select(null.alias("doc_id"), "page_id", *result))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labelled ones."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every twentieth document taken as a query."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"), k=10)


OP4_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x20\\x09-\\x0D]+')) AS term
  FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS len FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, CAST(sum(CAST(floor(
    d.tf * {bm25.K1 + 1} / (d.tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * len / mean)) * (ln(1 + (n - df + 0.5) / (df + 0.5)) * 1e6) + 0.5) AS BIGINT)) AS BIGINT) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN len ON len.doc_id = d.doc_id CROSS JOIN stats
  WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""



def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two tokenizers, aligned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    return alignment.align(docs, piece_model(BYTE_MODEL), piece_model(), kept=digest).withColumnRenamed("groups", "groups_sha256")


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    index = maxscore.Index(table(spark, sf_dir, "documents"))
    return index.search(table(spark, sf_dir, "benchmark"), k=20)


OP12_SQL = f"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), p)) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents WHERE doc_id IS NOT NULL), pattern),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT row, count(*) AS n FROM words GROUP BY ALL),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN stats GROUP BY term),
part AS (SELECT row, 75 + (25 * n * docs) // terms AS m FROM len CROSS JOIN stats),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), p)) AS term FROM benchmark, pattern WHERE item_id IS NOT NULL),
scores AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN part USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to byte-level ids and back, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, piece_model(BYTE_MODEL))
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_quality": (op2_quality, None),
    "op3_warc": (op3_warc, OP3_SQL),
    "op4_search": (op4_search, OP4_SQL),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_ngram_join": (op6_ngram_join, None),
    "op7_mixing": (op7_mixing, None),
    "op8_pii": (op8_pii, None),
    "op9_embedding_dedup": (op9_embedding_dedup, None),
    "op10_language_id": (op10_language_id, None),
    "op11_alignment": (op11_alignment, None),
    "op12_maxscore": (op12_maxscore, OP12_SQL),
    "op13_bpe": (op13_bpe, None),
}
