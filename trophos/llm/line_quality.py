"""Line-first quality rules in DataFrame operations.

Every line is judged on its own: boilerplate phrases, navigation, symbols,
shouting, and the punctuation that ends a sentence.  Lines that fail are taken
out, and a document is rejected if less than ``MIN_KEPT`` percent of its words
are left.  Statistics of the whole text come first: documents that are too short
or mostly repeat themselves fail whatever their lines.

Words are runs of characters other than space and ``\\x09``-``\\x0D``; lines are
split at ``\\n``.  Everything is computed within the row, without a shuffle.  Only
texts in which some three-word window occurs twice sort their windows.

A null, empty or blank text has no words: all counts are 0, it fails and is not
kept.  Repeated rows and ids are judged one by one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEATED = 50, 50
#: Percent of the words that must be in lines that pass.
MIN_KEPT = 50

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Phrases of page furniture, in lines of up to BOILERPLATE_WORDS words.
BOILERPLATE = (
    r"(?i)\b(lorem ipsum|javascript|cookies?|all rights reserved|terms of (use|service)|privacy policy"
    r"|sign (in|up)|log ?in|subscribe|click here|read more|share this|back to top)\b"
)
BOILERPLATE_WORDS = 12
#: A word that is a separator of a menu, and one that ends in symbols or in a shout.
SEPARATOR = r"(^|[\x20\x09-\x0D])[|>»›•·/\-]+(?=$|[\x20\x09-\x0D])"
SYMBOL_WORD = r"[#*$%&|<>~^_=+]{2,}(?=$|[\x20\x09-\x0D])"
SHOUT_WORD = r"!{2,}(?=$|[\x20\x09-\x0D])"
SENTENCE_END = r"[.!?:;,…。！？\"'”’»)\]](?=$|[\x20\x09-\x0D])"
#: A line of so many words or more needs a mark after one of them.
LONG_LINE = 8


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_passes(line: Column) -> Column:
    words = _count(line, WORD)
    menu = (_count(line, SEPARATOR) >= 2) & (_count(line, SEPARATOR) * 5 >= words)
    marked = (_count(line, SYMBOL_WORD) + _count(line, SHOUT_WORD)) * 10 > words * 3
    furniture = (words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    unpunctuated = (words >= LONG_LINE) & (_count(line, SENTENCE_END) == 0)
    return ~(menu | marked | furniture | unpunctuated)


def clean_lines(text: Column) -> Column:
    """The text without the lines that fail; lines without words stay as they are."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.filter(lines, line_passes), "\n")


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of three that occur twice or more."""
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    rows = rows.withColumn("_windows", F.when(n >= 3, window))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(twice, F.sort_array(placed))).drop("_windows")

    def at(i: Column) -> Column:
        return F.get("_sorted", i)["w"]

    place = F.transform(
        "_sorted",
        lambda x, i: F.when(F.coalesce(at(i - 1) == x["w"], F.lit(False)) | F.coalesce(at(i + 1) == x["w"], F.lit(False)), x["i"]),
    )
    rows = rows.withColumn("_places", F.sort_array(F.array_compact(place))).drop("_sorted")
    # a window covers its three words, or those up to the next such window
    covered = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_places")


def judge(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept_words (in lines that pass), kept.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn("_lines", lines)
    good = F.filter("_lines", line_passes)
    rows = rows.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOL).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _count(F.array_join(good, "\n"), WORD).alias("kept_words"),
    )
    rows = _repeated_words(rows).drop("_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * F.col("kept_words") >= MIN_KEPT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept"
    )


def clean(documents: DataFrame) -> DataFrame:
    """Adds clean_text, the text without failed lines; a null text stays null."""
    return documents.withColumn("clean_text", F.when(F.col("text").isNotNull(), clean_lines(F.col("text"))))
