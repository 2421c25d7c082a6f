"""Statistics of whole texts as Column expressions: words, symbols, repeated lines and repeated word windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word rule, the symbols that the rules count.
BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that a text has twice or more. Windows are sorted, so equal ones are neighbours: n log n for any length.

    `w` must be a column of the input, not an expression: lambdas read it once per word.
    """
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("gram"), i.alias("at"))))
    return F.array_sort(windows)


def covered(sorted_windows: Column) -> Column:
    """The positions of windows that have an equal neighbour, in ascending order."""
    pairs = F.zip_with(sorted_windows, F.slice(sorted_windows, 2, F.greatest(F.size(sorted_windows), F.lit(1))),
                       lambda a, b: F.when(a["gram"] == b["gram"], F.array(a["at"], b["at"])))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def words_under(positions: Column) -> Column:
    """How many words lie under 3-word windows at these ascending positions."""
    gaps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))),
                      lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")


def count_of(text: Column, kept: str) -> Column:
    """Characters of a class in a text."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def with_stats(docs: DataFrame, text: str = "text", repeats: bool = True) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_distinct, n_upper, n_marks, n_digits, n_chars_all and, on demand,
    n_repeat_words. A null text counts as empty. Columns of docs with these names are replaced; working columns are dropped."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.withColumn("__text", t).withColumn("__w", words(F.col("__text")))
    base = base.withColumn("__odd", F.regexp_replace("__text", f"[^A-Z0-9!?{SYMBOLS}]+", ""))
    base = base.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    odd, w, lines = F.col("__odd"), F.col("__w"), F.col("__lines")
    out = base.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace("__text", SPACE, "")).cast("long"),
        "n_chars_all": F.length("__text").cast("long"),
        "n_symbols": count_of(odd, SYMBOLS), "n_upper": count_of(odd, "A-Z"), "n_marks": count_of(odd, "!?"), "n_digits": count_of(odd, "0-9"),
        "n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
    })
    dropped = ["__text", "__odd", "__lines", "__w"]
    if repeats:
        out = out.withColumn("__grams", repeated_words(F.col("__w")))
        out = out.withColumn("__at", covered(F.col("__grams")))
        out = out.withColumn("n_repeat_words", words_under(F.col("__at")))
        dropped += ["__grams", "__at"]
    return out.drop(*dropped)


def ratios(prefix: str = "") -> dict[str, Column]:
    """Scale-free features of the counts; a text without words has 0 everywhere."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")
    return {
        f"{prefix}words": F.col("n_words").cast("double"), f"{prefix}word_length": share("word_chars", "n_words"),
        f"{prefix}symbols": share("n_symbols", "n_words"), f"{prefix}marks": share("n_marks", "n_words"),
        f"{prefix}upper": share("n_upper", "n_chars_all"), f"{prefix}digits": share("n_digits", "n_chars_all"),
        f"{prefix}distinct": share("n_distinct", "n_words"), f"{prefix}dup_lines": share("n_dup_lines", "n_lines"),
    }
