"""The corpus pipeline: stages over ``documents``, each calling one operator of ``lucarne.llm``.

Every stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``. Empty tables pass through all stages; null texts have no language and go in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucarne.llm import language, mixing, ngram_join, pieces, pii
from lucarne.llm.queries import piece_model
from lucarne.llm.shared import WORD, Staging, fresh


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """The documents with all columns but the used ones renamed, so that none is called like a column an operator makes, and the way back."""
    names = {c: c if c in used else f"other_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those in none of the corpus's languages go, declared languages stay as they are.

    Null and empty texts and texts without letters are in no language and go. Repeated rows go or stay together; an empty table stays empty.
    """
    model = language.train(docs, "text", "lang")
    rows, back = apart(docs, "text", "lang", "source")
    found = language.identify(rows, model, declared=F.col("lang"), host=F.col("source"), keep_text=True)
    return found.where("accepted").select(*back)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8: the one with the smallest id, and one of its equal rows.

    Documents without words are in no group and stay, and so do rows without an id.
    """
    found = ngram_join.linked_components(docs, words=5, percent=80)
    first = found.where((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD) & F.col("doc_id").isNotNull()
    digest = fresh(docs, "digest")
    kept = docs.where(worded).join(first, "doc_id", "left_semi").withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest])
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kind, and its length counted anew.

    Null texts stay null, with a null length, and empty ones empty; repeated rows repeat, and an empty table stays empty.
    """
    rows, back = apart(docs, "doc_id", "text", "n_chars")
    found = pii.find(rows, keep_text=True)
    hidden = found.withColumn("text", pii.redacted(F.col("text"), F.concat("base", "added")))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Documents without words (null and empty texts) weigh nothing and are never taken. Repeated rows are taken each by itself; a null
    source is a source, and an empty table stays empty.
    """
    rows, back = apart(docs, "doc_id", "text", "source")
    taken = mixing.mix(rows, mixing.word_count(F.col("text")), weights=(3.0, 1.0, 2.0), share=1.5)
    return mixing.repeated(taken).select(*back)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids (packed), their number, and the text that the ids decode to, in ids, n_tokens and decoded.

    Null and empty texts have the begin and end ids only. Repeated rows repeat; columns of the three names are replaced.
    """
    done = pieces.round_trip(docs, piece_model())
    return done.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language", by_language), ("near_copies", without_near_copies), ("personal_data", without_personal_data), ("mixing", mixed), ("tokens", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    staging, before = Staging(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, path = staging.write(stage(spark, docs, sf_dir))
        if before:
            staging.drop(before)
        before = path
    return docs


#: The stages are learned or iterative; SQL cannot state them. The tests hold them against plain versions.
ORACLE_SQL = None
