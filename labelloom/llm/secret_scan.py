"""Secrets by pattern, and by character Markov models of random strings and identifiers.

Base spans are found by pattern: assign (a value given to a name such as ``password``), access
(key ids), hex (long hexadecimal runs). The method adds spans of kind ``random``: runs of key
characters with a letter that look more like a random string than like an ordinary identifier.

Two first-order Markov models of characters are trained from samples that the patterns label:
random strings are the distinct secrets in base spans that hold a digit, identifiers the
distinct words of ``LEAST_IDENTIFIER`` characters or more outside them. All documents are
counted. A run's score is the sum over its characters of the log ratio of both models, and it
is a secret from ``THRESHOLD`` on. Scores are whole thousandths of a nat, so they add up alike
in any order.

Everything is made of DataFrame functions. A pattern's places follow from the lengths of its
matches and of the gaps between them, summed by a window per document.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.llm.common import discard, stored

KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
LEAST_RUN = 16
LEAST_IDENTIFIER = 6
THRESHOLD = 12_000
SCALE = 1000
PRIOR = 16
#: Characters of a run; the models know these and the begin of a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
BEGIN = "^"
_CODES = 128

# The patterns of the base kinds.
_NAME = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are matched whole from their first character on, so a length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
_RUN = "[A-Za-z0-9+/_=]"
# A run of digits and signs alone is a number or a rule, no key.
RUN = rf"(?<!{_RUN})(?=[0-9+/_=]*[A-Za-z]){_RUN}{{{LEAST_RUN},}}"
IDENTIFIER = rf"(?<!{_RUN})[A-Za-z_][A-Za-z0-9_]{{{LEAST_IDENTIFIER - 1},}}(?!{_RUN})"
PATTERNS = (ASSIGN, ACCESS, HEX, RUN)


def _matches(kind: int, pattern: str, value_group: int) -> Column:
    """Per match of a text: kind, number, length of the gap before it, the match, its value."""
    text, re = F.col("text"), F.lit(pattern)
    found = F.regexp_extract_all(text, re, F.lit(0))
    values = F.regexp_extract_all(text, re, F.lit(value_group)) if value_group else found
    zipped = F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("g"))
    # The last gap follows the last match.
    rows = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.char_length(x["g"]).alias("gap"), x["m"].alias("found"),
            x["v"].alias("value"),
        ),
    )
    return F.when(F.regexp_like(text, re), rows).otherwise(F.array().cast(rows_type()))


def rows_type() -> str:
    return "array<struct<kind:int,at:int,gap:int,found:string,value:string>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row of the table: a number, the id, and all matches; stored, which fixes the numbers."""
    every = F.concat(*[_matches(k, p, 2 if p is ASSIGN else 0) for k, p in enumerate(PATTERNS)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.select("row", "doc_id", every.alias("matches")), "secret-matches")


def _placed(found: DataFrame) -> DataFrame:
    """``(row, kind, start, end, found, value)`` of every match."""
    window = Window.partitionBy("row", "kind").orderBy("at")
    size = F.char_length("found")
    # All windows of a document work on one shuffle.
    rows = found.where(F.size("matches") > 0).select("row", F.inline("matches")).repartition("row")
    ends = rows.withColumn("end", F.sum(F.col("gap") + size).over(window).cast("long"))
    return ends.select("row", "kind", (F.col("end") - size).alias("start"), "end", "found", "value")


def random_strings(found: DataFrame) -> DataFrame:
    """Distinct secrets of base spans that hold a digit: the sample of random strings."""
    rows = found.select(F.explode("matches").alias("m")).where(f"m.kind < 3 AND char_length(m.value) >= {LEAST_VALUE}")
    return rows.select(F.col("m.value").alias("string")).where(F.regexp_like("string", F.lit("[0-9]"))).distinct()


def identifiers(docs: DataFrame) -> DataFrame:
    """Distinct words outside base spans: the sample of ordinary identifiers."""
    base = F.lit("|".join((ASSIGN, ACCESS, HEX)))
    outside = F.when(F.regexp_like("text", base), F.regexp_replace("text", base, F.lit(" "))).otherwise(F.col("text"))
    words = docs.select(F.explode(F.regexp_extract_all(outside, F.lit(IDENTIFIER), F.lit(0))).alias("string"))
    return words.distinct()


def transitions(strings: DataFrame) -> DataFrame:
    """``(pair, n)``: how often each character follows another, or begins a string."""
    marked = F.concat(F.lit(BEGIN), F.col("string"))
    steps = F.transform(F.sequence(F.lit(1), F.char_length("string")), lambda i: F.substring(marked, i, F.lit(2)))
    return strings.select(F.explode(steps).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(random: dict[str, int], ordinary: dict[str, int], scale: int = SCALE) -> dict[str, int]:
    """Per pair of characters the log ratio of both models, in whole thousandths.

    A model's chance of a character after another rests on their count, and like ``PRIOR`` more
    observations on the character's own share among all, each of which counts one more.
    """

    def model(counts: dict[str, int]) -> dict[str, float]:
        before, own = dict.fromkeys(BEGIN + ALPHABET, 0), dict.fromkeys(ALPHABET, 1)
        for pair, n in counts.items():
            if pair[0] in before and pair[1] in own:
                before[pair[0]] += n
                own[pair[1]] += n
        every = sum(own.values())
        return {
            a + b: (counts.get(a + b, 0) + PRIOR * own[b] / every) / (before[a] + PRIOR) for a in before for b in own
        }

    first, second = model(random), model(ordinary)
    return {pair: math.floor(scale * math.log(p / second[pair])) for pair, p in first.items()}


def train(docs: DataFrame, found: DataFrame) -> dict[str, int]:
    """The log ratios; at most a row per pair of known characters comes to the driver."""
    known = F.regexp_like("pair", F.lit(rf"^[{ALPHABET}{BEGIN}][{ALPHABET}]$"))
    both = (
        transitions(x).where(known).collect() for x in (random_strings(found), identifiers(docs))
    )
    return log_ratios(*({r["pair"]: r["n"] for r in rows} for rows in both))


def _ratio_table(ratios: dict[str, int]) -> Column:
    """The log ratios as one constant array, by the codes of both characters."""
    cells = ["0"] * (_CODES * _CODES)
    for pair, value in ratios.items():
        cells[ord(pair[0]) * _CODES + ord(pair[1])] = str(value)
    return F.split(F.lit(",".join(cells)), ",").cast("array<int>")


def log_likelihood_ratio(string: Column, ratios: dict[str, int]) -> Column:
    """Sum of the log ratios over the characters of a string of the alphabet."""
    cells = _ratio_table(ratios)
    marked = F.concat(F.lit(BEGIN), string)

    def step(total: Column, i: Column) -> Column:
        pair = F.substring(marked, i, F.lit(2))
        code = F.ascii(pair) * _CODES + F.ascii(F.substring(pair, 2, 1))
        return total + F.get(cells, code)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(string)), F.lit(0), step)


def spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, base`` spans and ``all`` spans, each by start, then kind.

    Null and empty texts have none; repeated rows come back as often and count as often. Base
    spans may overlap each other; an added span overlaps none. Without base spans there are no
    random strings to learn from, and the scores rest on identifiers alone. An empty table gives
    no rows.
    """
    found = find(docs)
    ratios = train(docs, found)
    placed = _placed(found)
    is_base = F.col("kind") < 3
    # Kind 0 may fail by its value, kind 3 by its score.
    score = F.when(~is_base, log_likelihood_ratio(F.col("found"), ratios))
    kept = placed.where(
        F.when(F.col("kind") == 0, F.char_length("value") >= LEAST_VALUE).otherwise(is_base | (score >= threshold))
    ).select("row", "kind", "start", "end")
    up = Window.partitionBy("row").orderBy("start")
    down = Window.partitionBy("row").orderBy(F.desc("start"))
    touched = (F.coalesce("before", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end"))
    apart = (
        kept.withColumn("before", F.max(F.when(is_base, F.col("end"))).over(up))
        .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(down))
        .where(is_base | ~touched)
    )
    listed = apart.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    whole = found.select("row", "doc_id").join(listed, "row", "left").withColumn("all", F.coalesce("all", none))
    return whole.select("doc_id", F.filter("all", lambda s: s["kind"] < 3).alias("base"), "all")


def written(spans_: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return spans(docs, threshold).select(
        "doc_id", *map(count, range(3)), F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans")
    )
