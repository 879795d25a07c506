"""Text columns: cleaning, tokens, excerpts, titles and keys.  Pure Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.constants import (
    MASK_NAMES, NON_WORD, TITLE_ACRONYMS, TITLE_SMALL_WORDS, WHITESPACE,
)


def squeeze(text: Column) -> Column:
    """Collapse white space to single spaces and trim."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column, max_length: int | None = None, min_length: int = 10) -> Column:
    """Cleaned text, or null when nothing usable is left.  The order of the steps matters."""

    def unmask(squeezed: Column) -> Column:
        unwrapped = F.when(
            squeezed.startswith("[") | squeezed.startswith("{"),
            squeeze(F.regexp_replace(squeezed, "[\\[\\]{}\"']", " ")),
        ).otherwise(squeezed)
        masked = F.regexp_replace(unwrapped, r"(?i)<\{?entity_type\}?>", " ")
        masked = F.regexp_replace(masked, r"<[^>]+>", " ")
        masked = F.regexp_replace(masked, r"(?i)\[(" + "|".join(MASK_NAMES) + r"|pii)\]", " ")
        plain = F.regexp_replace(F.regexp_replace(masked, r"\x00", ""), r"[\r\t]", " ")
        return F.when(F.length(squeezed) >= min_length, plain)

    def shorten(plain: Column) -> Column:
        if max_length is None:
            return F.trim(plain)
        cut = F.substring(plain, 1, max_length)
        from_end = F.instr(F.reverse(cut), ".")
        last_period = max_length - from_end
        shortened = F.when(
            (from_end > 0) & (last_period > 0.8 * max_length), F.substring(plain, F.lit(1), last_period + 1)
        ).otherwise(F.concat(cut, F.lit("...")))
        return F.trim(F.when(F.length(plain) > max_length, shortened).otherwise(plain))

    final = let(let(squeeze(text), unmask), shorten)
    return let(final, lambda t: F.when(F.length(t) >= min_length, t))


def clean_for_prompt(text: Column) -> Column:
    """Drop tags, collapse a word said three or more times in a row, squeeze white space."""
    no_tags = F.regexp_replace(text, r"<[^>]+>", "")
    once = F.regexp_replace(no_tags, r"(?U)\b(\w+)(\s+\1){2,}\b", "$1")
    return squeeze(once)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WHITESPACE), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def without(tokens: Column, words: list[str], min_chars: int = 1) -> Column:
    """Tokens of at least ``min_chars`` characters that are not in a fixed word list."""
    if not words and min_chars == 1:
        return F.array_remove(tokens, "")
    return F.filter(tokens, lambda w: (F.length(w) >= min_chars) & ~w.isin(list(words)))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of ``low``..``high`` tokens, joined by a space: shorter grams zipped with the tokens after them."""

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        head = tokens if n == 2 else of_size(n - 1)
        return F.zip_with(F.slice(head, F.lit(1), count), F.slice(tokens, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))

    parts = [of_size(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def prompt_excerpt_length(docs_shown: Column | int) -> Column:
    shown = docs_shown if isinstance(docs_shown, Column) else F.lit(docs_shown)
    return F.when(shown >= 40, 400).when(shown >= 20, 500).when(shown >= 10, 600).otherwise(800)


def clean_phrase(phrase: Column) -> Column:
    return squeeze(F.regexp_replace(phrase, r"[^\p{L}\p{N}_\s-]", " "))


def _capitalise(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    head = F.when(first == "ß", "Ss").otherwise(F.upper(first))
    return F.concat(head, F.lower(F.substring(word, F.lit(2), F.length(word))))


def title_case(text: Column) -> Column:
    """Capitalise words; acronyms stay upper case, small words after the first stay lower case."""
    acronyms = [a for a in TITLE_ACRONYMS if a == a.upper()]

    def one(word: Column, i: Column) -> Column:
        bare = F.regexp_replace(word, r"[^\p{L}\p{N}_-]", "")
        return (
            F.when(F.upper(bare).isin(acronyms), F.upper(bare))
            .when((i > 0) & F.lower(bare).isin(TITLE_SMALL_WORDS), F.lower(bare))
            .otherwise(_capitalise(bare))
        )

    words = F.filter(F.split(text, WHITESPACE), lambda w: w != "")
    return F.array_join(F.transform(words, one), " ")


def keyword_title(word: Column) -> Column:
    """Title form of one keyword: every run of letters starts with a capital."""
    return F.initcap(word)


def query_key(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def topic_reference(question: Column) -> Column:
    """The first topic number named in a question, or null."""
    digits = F.regexp_extract(F.lower(question), r"topic\s+(\d+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def seed_words(line: Column) -> Column:
    """Comma-separated words of one line, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(line, ","), lambda w: F.trim(w)), lambda w: w != "")
