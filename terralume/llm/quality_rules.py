"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Counts are whole-text columns; a rule bounds a ratio of them. Words found in repeated windows are
counted by sorting (hash, position) keys inside the row, in n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Very common words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "auf das den der die ein eine für ich im ist mit nicht sich und von zu "
    "con del el los las mi no por se su una y"
).split()

#: (rule, ratio as SQL over the count columns, least, most); a document passes if every ratio is in its bounds.
RULES = (
    ("word_length", "word_chars / n_words", 1.5, 12.0),
    ("symbols", "n_symbols / n_words", 0.0, 0.2),
    ("shouting", "n_bangs / n_words", 0.0, 0.3),
    ("stop_words", "n_stop_words / n_words", 0.03, 1.0),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.6),
    ("repeated_words", "n_same_as_last / n_words", 0.0, 0.3),
)

_WORDS = r"[\x20\x09-\x0D]+"


def _repeat_words() -> str:
    """SQL over w and n_words: words in windows of three that are found twice or more."""
    return """
    case when n_words < 4 then 0L else size(array_distinct(flatten(transform(flatten(filter(
        zip_with(slice(k, 1, size(k) - 1), slice(k, 2, size(k) - 1), (a, b) ->
            if(shiftright(a, bits) = shiftright(b, bits)
               and element_at(z, cast(a & (shiftleft(1L, bits) - 1) as int) + 1) = element_at(z, cast(b & (shiftleft(1L, bits) - 1) as int) + 1),
               array(a & (shiftleft(1L, bits) - 1), b & (shiftleft(1L, bits) - 1)), null)),
        p -> p is not null)), p -> array(p, p + 1, p + 2))))) end
    """


def counts(docs: DataFrame) -> DataFrame:
    """The documents' columns doc_id and counts, one row each. A null text has none of anything.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, of any length; repeated rows stay rows.
    """
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", text.alias("t"), F.array_remove(F.split(text, _WORDS), "").alias("w"))
    x = x.withColumn("n_words", F.size("w").cast("long"))
    x = x.withColumn("z", F.expr("if(n_words < 4, null, slice(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w))), 1, size(w) - 2))"))
    x = x.withColumn("bits", F.expr("cast(ceil(log2(n_words + 1)) as int)"))
    x = x.withColumn("k", F.expr("sort_array(transform(z, (s, i) -> shiftleft(xxhash64(s), bits) | i))"))
    x = x.withColumn("l", F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    stops = ", ".join(f"'{s}'" for s in STOP_WORDS)
    return x.select(
        "doc_id",
        "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr("cast(size(l) - size(array_distinct(l)) as long)").alias("n_dup_lines"),
        F.expr(f"cast({_repeat_words()} as long)").alias("n_repeat_words"),
        F.expr("cast(size(l) as long)").alias("n_lines"),
        F.regexp_count("t", F.lit("!!")).cast("long").alias("n_bangs"),
        F.expr(f"cast(size(filter(w, s -> s in ({stops}))) as long)").alias("n_stop_words"),
        F.expr("cast(if(n_words < 2, 0, size(filter(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w)), (a, b) -> a = b), e -> e))) as long)").alias("n_same_as_last"),
    )


def compiled(rules=RULES) -> Column:
    """The table as one condition over the counts; a ratio without words fails."""
    out = F.lit(True)
    for _, ratio, least, most in rules:
        out = out & F.coalesce(F.expr(f"if(n_words > 0, ({ratio}) between {least}D and {most}D, false)"), F.lit(False))
    return out


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts of every document with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))
