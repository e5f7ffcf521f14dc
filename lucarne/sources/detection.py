"""What a text file is made of: encoding, byte-order mark, separator (SRC-7 to SRC-9)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucarne.functions.vocabulary import SEPARATORS

UTF8, LATIN1, UTF16_LE, UTF16_BE = "UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"
#: Read as ISO-8859-1, which Spark's reader knows, and then translated.
CP1252 = "windows-1252"
SEPARATOR_LINES = 5


def _starts(value: Column, mark: bytes) -> Column:
    return F.substring(value.cast("binary"), 1, len(mark)) == F.lit(mark)


def _opens_quote(line: Column, separator: str) -> Column:
    """Whether a quoted cell begins in this line and does not end in it."""
    mark = f"(^|{_literal(separator)})"
    bare = F.replace(line, F.lit('""'), F.lit(""))  # escaped quotes and empty quoted cells
    rest = F.regexp_replace(bare, f'{mark}"[^"]*+"(?={_literal(separator)}|$)', "$1")
    return F.when(F.contains(line, F.lit('"')), rest.rlike(f'{mark}"')).otherwise(False)


def _literal(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def describe_files(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """``(path, encoding, has_bom)`` per file, and with a separator ``open_quotes``: whether cells run over line breaks; one scan.

    Lines keep their bytes until they are decoded, so whole files are checked in splittable reads,
    not their first kilobytes and not one blob per task. Valid UTF-8 is UTF-8, a UTF-16 mark at the
    start of the file says UTF-16, a byte that ISO-8859-1 has no character for says Windows-1252, the rest is ISO-8859-1.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("head")
    )
    value = F.col("value")
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(F.decode(value.cast("binary"), LATIN1).rlike(r"[\x80-\x9f]")).alias("cp1252"),
        F.bool_or(F.col("head") & _starts(value, b"\xff\xfe")).alias("le"),
        F.bool_or(F.col("head") & _starts(value, b"\xfe\xff")).alias("be"),
        F.bool_or(F.col("head") & _starts(value, b"\xef\xbb\xbf")).alias("mark"),
        # Bytes of UTF-16 are read as characters of their own; zeros between them are left out.
        F.bool_or(_opens_quote(F.replace(F.decode(value.cast("binary"), LATIN1), F.lit("\0"), F.lit("")), separator) if separator else F.lit(False)).alias("open_quotes"),
    )
    return facts.select(
        "path",
        F.when(F.col("le"), UTF16_LE).when(F.col("be"), UTF16_BE).when(F.col("utf8"), UTF8).when(F.col("cp1252"), CP1252).otherwise(LATIN1).alias("encoding"),
        (F.col("le") | F.col("be") | F.col("mark")).alias("has_bom"), "open_quotes",
    )


def detect_encoding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, encoding, has_bom)`` per file (SRC-8, SRC-9)."""
    return describe_files(spark, path).drop("open_quotes")


def from_cp1252(value: Column) -> Column:
    """Text read as ISO-8859-1 that was written in Windows-1252; bytes without a character there stay as they are."""
    known = [(chr(b), bytes([b]).decode(CP1252)) for b in range(0x80, 0xA0) if bytes([b]).decode(CP1252, "ignore")]
    return F.translate(value, "".join(a for a, _ in known), "".join(b for _, b in known))


def files_by_kind(spark: SparkSession, path: str | list[str], separator: str) -> dict[tuple[str, bool], list[str] | None]:
    """Files per encoding and whether they hold line breaks in quotes; None stands for "all of them" where there is but one kind."""
    found = describe_files(spark, path, separator).orderBy("path").collect()
    groups: dict[tuple[str, bool], list[str]] = {}
    for file, encoding, _, open_quotes in found:
        groups.setdefault((encoding, open_quotes), []).append(unquote(file))
    if len(groups) > 1:
        return dict(sorted(groups.items()))
    return {next(iter(groups), (UTF8, False)): None}


def separator_scores(lines: DataFrame) -> DataFrame:
    """Mean count of each candidate over the non-blank lines (SRC-7)."""
    value = F.col("value")
    counts = [F.coalesce(F.avg(F.length(value) - F.length(F.replace(value, F.lit(s)))), F.lit(0.0)) for s in SEPARATORS]
    candidates = F.array(*[
        F.struct(F.lit(s).alias("separator"), c.alias("score"), F.lit(i).alias("preference"))
        for i, (s, c) in enumerate(zip(SEPARATORS, counts))
    ])
    return lines.filter(F.trim(value) != "").agg(candidates.alias("c")).selectExpr("inline(c)")


def detect_separator(spark: SparkSession, path: str | list[str]) -> str:
    """The separator seen most per line in the first lines; ties and none at all go to the first candidate."""
    head = spark.read.text(path).limit(SEPARATOR_LINES)
    best = separator_scores(head).orderBy(F.desc("score"), "preference").first()
    return best["separator"]
