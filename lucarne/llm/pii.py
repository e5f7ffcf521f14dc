"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find emails, ip addresses, card and phone numbers by their form. They are the seeds: the words around them
make lexical patterns (the word before, the word after, and both). Tokens that resemble a kind but fail its form, such as a phone
number without prefix, are the unseen instances. Patterns and values form a graph over the whole corpus, kept as
distinct (pattern, value) links. Scores go back and forth: a pattern's confidence in a kind is the mean score of its values,
drawn down by ``doubt`` values of no kind; a value's score is the noisy-or of its patterns; seeds stay at one. After ``rounds`` the
patterns with enough seeds and confidence are accepted, and the tokens they stand around, if they resemble the kind, are added
to the base spans. Copies of a document add nothing to a pattern, since links are distinct.

The texts are read once: spans, tokens and their contexts are written by row, and all that follows works on them.

The regular expressions are the plain forms with possessive repeats and a check that a match does not begin inside a run, which
finds the same matches in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucarne.llm.shared import Staging, fresh

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Fixed forms of the four kinds.
FORMS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPACE = r"\x20\x09-\x0D"
#: A token with a digit or an at sign, and the value inside it.
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
VALUE = rf"[{_LOCAL}]*+@[A-Za-z0-9.-]*+|[+(]?[0-9][0-9().-]*"
TOKEN_KIND = "token"
#: Characters of context looked at on either side of a match; words beyond that are cut.
CONTEXT = 64
#: Matches that are put together at a time; appending to one array would take time quadratic in their number.
BLOCK = 64
#: Longest value that the bootstrap considers, the length limit of an address.
LONGEST = 254
SPAN = "array<struct<kind: string, start: int, end: int, value: string, left: string, right: string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def weighed(i: Column) -> Column:
        d = digits.substr(-i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(at, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _word_before(part: Column) -> Column:
    """The text joined to a match if there is any, else the word before it."""
    near = F.translate(F.right(part, F.lit(CONTEXT)), "\t\n\x0b\f\r", " " * 5)
    joined = F.substring_index(near, " ", -1)
    return F.lower(F.when(joined != "", joined).otherwise(F.substring_index(F.rtrim(near), " ", -1)))


def _word_after(part: Column) -> Column:
    near = F.ltrim(F.translate(F.left(part, F.lit(CONTEXT)), "\t\n\x0b\f\r", " " * 5))
    return F.lower(F.substring_index(near, " ", 1))


def _cut(df: DataFrame, text: str, forms: dict[str, str]) -> DataFrame:
    """Per form a column of its matches and, where there are any, one of the parts of the text around them."""
    hints = {"email": "@", "phone": "+", "ip": "."}
    none = F.array().cast("array<string>")
    all_of = {k: F.regexp_extract_all(F.col(text), F.lit(form), F.lit(0)) for k, form in forms.items()}
    df = df.withColumns({_found(k): F.when(F.col(text).contains(hints[k]), m).otherwise(none) if k in hints else m for k, m in all_of.items()})
    return df.withColumns({_parts(k): F.when(F.size(_found(k)) > 0, F.split(text, form, -1)).otherwise(none) for k, form in forms.items()})


def _found(kind: str) -> str:
    return f"found of {kind}"


def _parts(kind: str) -> str:
    return f"parts around {kind}"


def located(kind: str, good: Callable[[Column], Column]) -> Column:
    """The good matches that ``_cut`` found as structs kind, start, end, value, left, right; offsets in code points, end exclusive."""
    parts = F.col(_parts(kind))
    rows = F.arrays_zip(F.col(_found(kind)).alias("value"), F.slice(parts, 1, F.size(_found(kind))).alias("part"), F.slice(parts, 2, F.size(_found(kind))).alias("after"))
    empty = F.array().cast(SPAN)

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["part"])
        end = start + F.length(row["value"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), row["value"].alias("value"),
            _word_before(row["part"]).alias("left"), _word_after(row["after"]).alias("right"),
        )
        spans = F.when(good(row["value"]), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def add_block(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), empty.alias("spans"))
        return F.aggregate(block, begin, add, lambda s: F.struct(s["at"].alias("at"), F.array_append(state["blocks"], s["spans"]).alias("blocks")))

    def walk(all_rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(all_rows) - 1, F.lit(BLOCK)), lambda i: F.slice(all_rows, i + 1, BLOCK))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        return F.aggregate(blocks, begin, add_block, lambda s: F.flatten(s["blocks"]))

    return F.when(F.size(_found(kind)) > 0, once(rows, walk)).otherwise(empty)


def _resembles(value: Column) -> Column:
    """The kinds that a value without a valid form resembles; above ``LONGEST`` characters none."""
    count = F.length(_digits(value))
    numeric = ~value.contains("@")
    return F.filter(F.when(F.length(value) > LONGEST, F.array().cast("array<string>")).otherwise(F.array(
        F.when(value.rlike("[A-Za-z0-9]@") | value.rlike("@[A-Za-z0-9]"), F.lit("email")),
        F.when(numeric & value.rlike(r"^[0-9]++(?:\.[0-9]++){2,}+$"), F.lit("ip")),
        F.when(numeric & count.between(12, 19), F.lit("card")),
        F.when(numeric & count.between(6, 15), F.lit("phone")),
    )), lambda k: k.isNotNull())


def _loose(base: Column) -> Column:
    """Values in tokens that no base span touches, as spans without a kind; the start of the token is context."""

    def inner(token: Column) -> Column:
        value = F.regexp_extract(token["value"], VALUE, 0)
        shift = F.instr(token["value"], value) - 1
        start = token["start"] + shift
        return F.struct(
            F.lit(None).cast("string").alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.when(shift > 0, F.lower(F.left(token["value"], shift))).otherwise(token["left"]).alias("left"), token["right"].alias("right"),
        )

    def free(both: Column) -> Column:
        return F.filter(both["tokens"], lambda s: ~F.exists(both["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    like = lambda token: F.size(_resembles(F.regexp_extract(token, VALUE, 0))) > 0
    tokens = F.transform(located(TOKEN_KIND, like), inner)
    return once(F.struct(base.alias("base"), tokens.alias("tokens")), free)


def base_spans() -> Column:
    """Valid spans of the four kinds that ``_cut`` found, kind by kind in their fixed order, then by start."""
    return F.concat(*(located(kind, partial(_valid, kind)) for kind in KINDS))


def accepted_patterns(spans: DataFrame, staging: Staging, rounds: int, seeds: int, confidence: float, doubt: float) -> DataFrame:
    """Patterns with the kind that they announce; ``spans`` has kind (null: unseen), value, left and right."""
    known = spans.where((F.col("left") != "") | (F.col("right") != ""))
    names = F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"), F.concat(F.lit("="), "left", F.lit(" "), "right"))
    links = staging.keep(known.select(F.explode(names).alias("pattern"), "value", "kind").where("length(pattern) > 1").distinct())
    held = links.where(F.col("kind").isNotNull())
    # Scores of unseen values; seeds count as one of their own kind.
    scores = None
    for step in range(rounds):
        per = held.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.count("*").cast("double").alias("mass"))
        if scores is not None:
            more = links.where(F.col("kind").isNull()).drop("kind").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("added"))
            per = per.join(more, ["pattern", "kind"], "left").withColumn("mass", F.col("mass") + F.coalesce("added", F.lit(0.0))).drop("added")
        size = links.groupBy("pattern").agg(F.count("*").alias("size"))
        judged = per.join(size, "pattern").select("pattern", "kind", "seeds", (F.col("mass") / (F.col("size") + doubt)).alias("confidence"))
        patterns = staging.keep(judged.where(F.col("seeds") >= seeds))
        if step + 1 < rounds:
            unseen = links.where(F.col("kind").isNull()).drop("kind").join(patterns, "pattern")
            alike = unseen.where(F.array_contains(_resembles(F.col("value")), F.col("kind")))
            scores = staging.keep(alike.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score")))
    return patterns.where(F.col("confidence") >= confidence).select("pattern", "kind")


def find(
    df: DataFrame, text: str = "text", rounds: int = 3, seeds: int = 20, confidence: float = 0.9, doubt: float = 1.0, keep_text: bool = False,
) -> DataFrame:
    """Each row with ``base`` and ``added``, arrays of spans (kind, start, end, value, left, right); both names are replaced.

    Null and empty texts have no spans. Equal rows keep their own spans; an empty table stays empty. Added spans are those of
    accepted patterns, outside all base spans, the kind being the first by name among those announced. The text
    itself is carried on only if ``keep_text``.
    """
    staging = Staging(df.sparkSession, "pii")
    names = [c for c in df.columns if c.lower() not in ("base", "added") and (keep_text or c != text)]
    row, tokens = fresh(df, "row"), fresh(df, "tokens")
    whole = fresh(df, "whole")
    found = _cut(df.withColumn(whole, F.coalesce(F.col(text), F.lit(""))), whole, {**FORMS, TOKEN_KIND: TOKEN})
    found = found.withColumn("base", base_spans()).withColumn(tokens, _loose(F.col("base"))).select(*names, "base", tokens)
    rows = staging.keep(found.withColumn(row, F.monotonically_increasing_id()))
    spans = rows.select(F.explode(F.concat("base", F.col(tokens))).alias("s")).select("s.kind", "s.value", "s.left", "s.right")
    patterns = staging.keep(accepted_patterns(spans, staging, rounds, seeds, confidence, doubt))
    loose = rows.select(F.col(row).alias("row"), F.explode(tokens).alias("s"))
    keys = F.array(F.concat(F.lit("<"), "s.left"), F.concat(F.lit(">"), "s.right"), F.concat(F.lit("="), "s.left", F.lit(" "), "s.right"))
    hits = loose.withColumn("pattern", F.explode(keys)).join(patterns, "pattern").where(F.array_contains(_resembles(F.col("s.value")), F.col("kind")))
    one = hits.groupBy("row", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.min("kind").alias("kind"), F.first("s").alias("s"))
    span = F.struct("kind", "start", "end", F.col("s.value").alias("value"), F.col("s.left").alias("left"), F.col("s.right").alias("right"))
    added = one.groupBy("row").agg(F.sort_array(F.collect_list(span)).cast(SPAN).alias("added")).withColumnRenamed("row", row)
    return rows.join(added, row, "left").select(*names, "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def in_order(spans: Column) -> Column:
    """Spans as kind:start:end, by kind in their fixed order, then start, comma-joined."""
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: F.coalesce(*(F.when(s["kind"] == k, F.lit(i)) for k, i in order.items()))
    keyed = F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("n")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["n"], s["s"], s["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the one that begins first is named."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["kind"].alias("kind"))))

    def replaced(both: Column) -> Column:
        text = both["text"]

        def add(state: Column, s: Column) -> Column:
            gap = F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
            out = F.when(s["start"] >= state["at"], gap).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], -s["longest"]).alias("at"), out.alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(both["spans"], begin, add, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))

    return F.when(F.size(spans) > 0, once(F.struct(text.alias("text"), keyed.alias("spans")), replaced)).otherwise(text)
