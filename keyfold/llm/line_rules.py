"""Line-first quality rules in DataFrame functions only.

Rules look at each line first: too many symbols or shouting marks, navigation bars,
boilerplate phrases. Failing lines are removed, and a document that loses too much of
its text is rejected; so is one that fails the base rules on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is navigation if two of these separators stand between or after its words.
NAVIGATION = r"\S +[|>»•·] +\S.*[|>»•·]"
#: A line is boilerplate if one of these phrases is in it.
BOILERPLATE = r"(?i)(all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)|enable javascript|sign (in|up) (to|for)|subscribe to our|click here to)"
#: A line fails with more than one symbol or exclamation mark for so many characters.
CHARS_PER_MARK = 10
MOST_LOST_PERCENT = 50
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5


def line_fails(line: Column) -> Column:
    """Whether a line fails the punctuation, navigation or boilerplate rule; empty lines never do."""
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS + "!", ""))
    return (marks * CHARS_PER_MARK > F.length(line)) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def repeated_words() -> Column:
    """The words in windows that occur twice or more, from the column of places of such windows in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.coalesce(F.aggregate("places", start, step, lambda acc: acc["n"]), F.lit(0))


def apply_rules(df: DataFrame, id_column: str, text_column: str, clean_text: bool = False) -> DataFrame:
    """Evaluates line rules and base rules on every whole text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines_removed, chars_removed (word characters of the removed lines), kept, and with
    ``clean_text`` the text without the failing lines. Null and empty texts have no words
    and fail the base rules. Repeated rows give repeated rows; other columns are not
    read. No shuffle: everything is computed within a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    df = df.select("id", text.alias("text"))
    df = df.select("id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.filter("lines", line_fails).alias("bad"))
    window = lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW)))
    windows = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.select("id", "text", "words", "lines", "bad", "n", windows.alias("windows"))
    # sorting is for the texts in which a window repeats; each step is a column, so lambdas read it and do not repeat it
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select("id", "text", "words", "lines", "bad", "n", ordered.alias("ordered"))
    twin = lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])
    places = F.array_sort(F.filter(F.transform("ordered", lambda x, k: F.when(twin(x, k), x["i"])), lambda i: i.isNotNull()))
    df = df.select("id", "text", "words", "lines", "bad", "n", places.alias("places"))
    chars = lambda lines: F.length(F.translate(F.array_join(lines, ""), " \t\n\x0b\x0c\r", ""))
    df = df.select(
        "id",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words().cast("bigint").alias("n_repeat_words"),
        F.size("bad").cast("bigint").alias("n_lines_removed"),
        chars("bad").cast("bigint").alias("chars_removed"),
        *([F.array_join(F.filter(F.split("text", "\n"), lambda x: ~line_fails(x)), "\n").alias("clean_text")] if clean_text else []),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    lost = F.col("chars_removed") * 100 > F.col("word_chars") * MOST_LOST_PERCENT
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(F.col("id").alias(id_column), *first, failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_lines_removed", "chars_removed", *(["clean_text"] if clean_text else []))
