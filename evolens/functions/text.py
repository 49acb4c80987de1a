"""Text expressions: trimming, capping, tokens, sections, validation and grounding.

Every function returns a native column expression, so a whole explanation table
is cleaned, checked and grounded in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv

# A token stands alone: no letter, digit or underscore on either side. Spelled out
# because the meaning of a word boundary differs between Java versions.
HASH_TOKEN = rf"(?<![\p{{L}}\p{{N}}_])({fv.HASH_BODY})(?![\p{{L}}\p{{N}}_])"
WORD_RUN = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def strip(text: Column, chars: str = fv.WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def one_line(message: Column) -> Column:
    """Strip a message and put it on one line."""
    return F.replace(strip(message), F.lit("\n"), F.lit(" "))


def non_blank(text: Column) -> Column:
    return F.length(strip(text)) > 0


def first_non_empty(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def default_to(column: Column, value) -> Column:
    return F.coalesce(column, F.lit(value))


def cap(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def cap_marked(text: Column, limit: int, marker: str, placeholder: str | None = None) -> Column:
    """Cap long text and say so; put a placeholder where there is none."""
    capped = F.when(F.length(text) > limit, F.concat(cap(text, limit), F.lit(marker)))
    if placeholder is not None:
        capped = capped.when(text.isNull() | (text == ""), F.lit(placeholder))
    return capped.otherwise(text)


def short_hash(commit: Column, size: int = 8) -> Column:
    return F.substring(commit, 1, size)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN))


def replace_phrases(
    text: Column, pairs: Sequence[tuple[str, str]] = fv.PHRASE_REPLACEMENTS
) -> Column:
    """Replace phrases one after the other, whatever their case."""
    return reduce(
        lambda acc, pair: F.regexp_replace(acc, f"(?i)\\Q{pair[0]}\\E", pair[1]), pairs, text
    )


def hash_tokens(text: Column) -> Column:
    """All hash-like tokens of a text, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(HASH_TOKEN), F.lit(1))


def _supports(valid: Column, token: Column) -> Column:
    return valid.startswith(token) | token.startswith(F.substring(valid, 1, 7))


def referenced_commits(text: Column, valid: Column) -> Column:
    """The valid hashes a text refers to by prefix, in order of first mention."""
    first_match = F.transform(
        hash_tokens(text),
        lambda token: F.get(F.filter(valid, lambda v: _supports(v, token)), F.lit(0)),
    )
    return F.array_distinct(F.filter(first_match, lambda v: v.isNotNull()))


def mask_ungrounded(text: Column, valid: Column) -> Column:
    """Mask every hash-like token no valid hash supports.

    The text between tokens and the tokens themselves are put back together in
    one pass; a text without valid hashes stays as it is.
    """
    gaps = F.split(text, HASH_TOKEN)
    kept = F.transform(
        hash_tokens(text),
        lambda token: F.when(
            F.exists(valid, lambda v: _supports(v, token)), token
        ).otherwise(F.lit(fv.HASH_MASK)),
    )
    rebuilt = F.array_join(
        F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(kept, i), F.lit("")))), ""
    )
    return F.when(F.size(valid) > 0, rebuilt).otherwise(text)


def section(text: Column, heading: str) -> Column:
    """The body of the section under ``heading``, on one line; null when empty.

    A heading is any line holding ``## heading``. The section runs to the next
    line that starts with ``##`` and is not that heading again.
    """
    def is_heading(line: Column) -> Column:
        return line.contains(f"## {heading}")

    lines = F.split(text, "\n")
    begin = F.array_position(F.transform(lines, is_heading), F.lit(True)).cast("int")
    rest = F.slice(lines, begin + 1, F.size(lines))
    end = F.array_position(
        F.transform(rest, lambda line: line.startswith("##") & ~is_heading(line)), F.lit(True)
    ).cast("int")
    body = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    kept = F.filter(
        F.transform(F.filter(body, lambda line: ~is_heading(line)), lambda line: strip(line)),
        lambda line: F.length(line) > 0,
    )
    return F.when((begin > 0) & (F.size(kept) > 0), F.array_join(kept, " "))


def attention_signal(text: Column) -> Column:
    return F.coalesce(section(text, fv.SIGNAL_HEADING), F.lit(fv.NO_SIGNAL))


def change_summary(text: Column) -> Column:
    return F.coalesce(section(text, fv.SUMMARY_HEADING), cap(text, fv.FALLBACK_CHARS))


def with_validation(
    df: DataFrame, explanation: Column, provided: Column, output: str = "validation"
) -> DataFrame:
    """Check explanations: add a struct of valid flag, violations and word count.

    Null explanations get null. Words and violations are columns of their own on
    the way, so that each is worked out once per row.
    """
    provided = F.coalesce(provided, F.array().cast("array<string>"))
    lowered, words = F.lower(explanation), F.col("_words")
    rules = [F.when(words > fv.MAX_WORDS, F.format_string(fv.WORD_LIMIT_VIOLATION, words))]
    rules += [
        F.when(~explanation.contains(s), F.lit(fv.SECTION_VIOLATION % s))
        for s in fv.REQUIRED_SECTIONS
    ]
    rules += [
        F.when(lowered.contains(p), F.lit(fv.PHRASE_VIOLATION % p)) for p in fv.BANNED_PHRASES
    ]
    unknown = F.transform(
        F.filter(
            hash_tokens(explanation),
            lambda token: ~F.exists(provided, lambda commit: commit.contains(token)),
        ),
        lambda token: F.format_string(fv.COMMIT_VIOLATION, short_hash(token)),
    )
    violations = F.concat(F.array_compact(F.array(*rules)), unknown)
    checked = F.struct(
        (F.size("_violations") == 0).alias("valid"),
        F.col("_violations").alias("violations"),
        words.alias("word_count"),
    )
    return (
        df.withColumn("_words", word_count(explanation))
        .withColumn("_violations", violations)
        .withColumn(output, F.when(explanation.isNotNull(), checked))
        .drop("_words", "_violations")
    )
