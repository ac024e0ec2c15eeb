"""Text functions: templates, word tokens, padding, word swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from labelloom.functions.portable import uniform
from labelloom.functions.vectors import bind

# The word pattern (two or more letters, digits or underscores) and
# the two premise templates.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
AGAINST = "against"
AGREE_PREFIX = "I agree that "
DISAGREE_PREFIX = "I disagree that "
BECAUSE = ", because "


def stance_premise(conclusion: Column, stance: Column, premise: Column) -> Column:
    """The premise led by a sentence that states agreement or disagreement."""
    prefix = F.when(stance == AGAINST, DISAGREE_PREFIX).otherwise(AGREE_PREFIX)
    return F.concat(prefix, conclusion, F.lit(BECAUSE), premise)


def english_stop_words() -> tuple[str, ...]:
    """Spark's own English list."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def word_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more characters, without the stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    if not stop_words:
        return words
    listed = [w.lower() for w in stop_words]
    return F.filter(words, lambda w: ~w.isin(listed))


def pad_tokens(tokens: Column, length: int = 256, fill: int = 0) -> Column:
    """Cut or pad an array to exactly ``length`` entries."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill), length)), 1, length)


def attention_mask(tokens: Column, length: int = 256) -> Column:
    """1 for the places that hold a token, 0 for the padded ones."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(tokens)).cast("int")
    )


def split_words(text: Column) -> Column:
    """Blank-separated words; empty text gives an empty array."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def swap_rounds(words: Column, share: float = 0.3, least: int = 1, most: int = 10) -> Column:
    """How many swaps a text gets: a share of its words, within bounds."""
    wanted = F.floor(F.size(words) * F.lit(share))
    return F.greatest(F.lit(least), F.least(F.lit(most), wanted)).cast("int")


def swap_adjacent(words: Column, rounds: Column, seed: object, *keys: Column | str) -> Column:
    """Swap ``rounds`` seeded pairs of neighbouring words, one after the other.

    The place of round r is drawn from ``(seed, keys, r)``. The drawn swaps are composed first:
    each place they touch is followed back through them to the word it ends with, and the words
    are laid out once. Texts of fewer than two words come back unchanged.
    """

    def run(bound: Column) -> Column:
        pairs = F.size(bound) - 1

        def place(r: Column) -> Column:
            return F.floor(uniform(seed, *keys, r) * pairs).cast("int") + 1

        def source(places: Column) -> Column:
            """Touched place to the place its word comes from; both count from 1."""
            touched = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1))))
            latest = F.reverse(places)
            came = F.transform(touched, lambda i: F.aggregate(latest, i, _before_swap))
            return F.map_from_arrays(touched, came)

        def laid_out(sources: Column) -> Column:
            return F.transform(
                bound, lambda word, i: F.coalesce(F.get(bound, F.element_at(sources, i + 1) - 1), word)
            )

        places = F.transform(F.sequence(F.lit(1), rounds), place)
        return F.when(pairs >= 1, bind(bind(places, source), laid_out)).otherwise(bound)

    return bind(words, run)


def _before_swap(at: Column, place: Column) -> Column:
    """Where the word at a place stood before ``place`` and its next were swapped."""
    return F.when(at == place, place + 1).when(at == place + 1, place).otherwise(at)
