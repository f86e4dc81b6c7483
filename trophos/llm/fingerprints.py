"""Document fingerprints: one-permutation MinHash in DataFrame operations.

Every shingle of ``size`` words, A-Z in lower case, is hashed once; the high bits
of the hash name a bin, and a bin keeps its smallest hash.  An empty bin takes
the value of another by optimal densification: it tries bins in an order of its
own until one is filled.  The fingerprint packs the low bits of all bins, a
hexadecimal digit each.  Digits also agree by chance, in one of 16 cases, and
the likeness of two fingerprints is corrected for that.

A text with fewer words than a shingle is one shingle; one without words (null,
empty or blank) has an empty fingerprint, like another empty one (1) and unlike
any other (0).  Equal texts have equal fingerprints.  All of it is computed
within the row, whatever the length of the text.
"""

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4
#: Bins that an empty bin tries before all of them are ranked for it.
TRIES = 24
#: Parts of the id order for each shuffle partition, rows drawn for each part, bytes of a text that part an id.
PARTS, SAMPLED, START = 4, 16, 24
SPACE = r"[\x20\x09-\x0D]+"

#: The hash of an empty bin: all bits below the bin's number are set.
_LAST = (1 << (64 - BIN_BITS)) - 1


def _numbers(values: list[int], kind: str) -> Column:
    """A constant array; Spark folds it into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tries() -> list[int]:
    """For each bin the bins that it tries, one after the other."""
    pick = random.Random(11)
    return [pick.randrange(BINS) for _ in range(BINS * TRIES)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fingerprint(rows: DataFrame, text: str, to: str, size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of a column of texts without nulls, as a string of BINS digits."""
    words, hashes, bins = f"_{to}_words", f"_{to}_hashes", f"_{to}_bins"
    rows = rows.withColumn(words, F.array_remove(F.split(lower_ascii(F.col(text)), SPACE), ""))
    n = F.size(words)
    whole = F.array(F.xxhash64(words))
    shingles = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    )
    # with the hash of an empty bin added for each, every bin has a first element once they are sorted
    ends = _numbers(sorted(_signed(b << (64 - BIN_BITS) | _LAST) for b in range(BINS)), "bigint")
    rows = rows.withColumn(hashes, F.sort_array(F.concat(F.when(n >= size, shingles).otherwise(whole), ends)))
    rows = rows.withColumn(f"_{to}_any", n > 0).drop(words)
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    first = F.filter(hashes, lambda x, i: F.coalesce(bin_of(F.get(hashes, i - 1)) != bin_of(x), F.lit(True)))
    filled = F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_LAST)) != _LAST, x))
    rows = rows.withColumn(bins, filled).drop(hashes)
    tries = _numbers(_tries(), "int")

    def densified(x: Column, b: Column) -> Column:
        tried = [F.get(bins, F.get(tries, b * TRIES + t)) for t in range(TRIES)]
        ranked = F.transform(bins, lambda y, j: F.when(y.isNotNull(), F.struct(F.xxhash64(b, j).alias("r"), y.alias("y"))))
        return F.coalesce(x, *tried, F.array_min(ranked)["y"])

    digit = lambda x: F.substring(F.lit("0123456789abcdef"), (x.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1))
    digits = F.transform(bins, lambda x, b: digit(densified(x, b)))
    fingerprint = F.when(F.col(f"_{to}_any"), F.array_join(digits, "")).otherwise("")
    return rows.withColumn(to, fingerprint).drop(bins, f"_{to}_any")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 2.0**-LOW_BITS
    corrected = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    blank = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(F.col(a) == F.col(b), 1.0).when(blank, 0.0).otherwise(corrected)


def fingerprint(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_chars, fingerprint."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = with_fingerprint(rows, "_text", "fingerprint", size)
    return rows.select("doc_id", F.length("_text").cast("long").alias("n_chars"), "fingerprint")


# --- documents beside the next one ------------------------------------------


def _heads(rows: DataFrame) -> list[tuple[int | None, str]]:
    """First (doc_id, start) of each part, in order; the first one is that of all rows.

    The others are those of a sample of rows, whose size follows the number of
    shuffle partitions and not that of the rows.
    """
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, high = rows.agg(F.count("*"), F.max("doc_id")).first()
    first = rows.where(F.col("doc_id").eqNullSafe(F.lit(high).cast("long"))).agg(F.min("_start")).first()[0]
    drawn = rows.sample(fraction=min(1.0, SAMPLED * parts / max(n, 1)), seed=5).select("doc_id", "_start").collect()
    drawn = sorted(drawn, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["_start"]))
    cuts = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if drawn else []
    return list(dict.fromkeys([(high, first or ""), *((r["doc_id"], r["_start"]) for r in cuts)]))


def _dealt(documents: DataFrame) -> DataFrame:
    """(_part, _guest, doc_id, _text): rows in parts of about one size, largest id first, null ids last.

    Every part is followed by a guest: the first row of the part below it, and
    below the last part the first of all.  Parts begin at ids, and within an id
    at the start of a text, that a sample of rows has, so they follow the rows
    whatever gaps, clusters or repeated and null ids there are; a row finds its
    part by a binary search.  Texts are moved once.  Only rows of one id whose
    texts begin with the same ``START`` bytes cannot be parted.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    # hexadecimal digits are in the order of the bytes, and so in that of the texts
    rows = rows.withColumn("_start", F.hex(F.substring(F.encode("_text", "UTF-8"), 1, START)))
    heads = _heads(rows)
    known = sum(i is not None for i, _ in heads)
    ids, starts = _numbers([i or 0 for i, _ in heads], "bigint"), F.split(F.lit(",".join(s for _, s in heads)), ",")
    doc_id, start = F.col("doc_id"), F.col("_start")

    def reached(place: Column) -> Column:
        """Whether the row is the head of this number or comes after it."""
        further = start >= F.get(starts, place)
        among_ids = doc_id.isNull() | (doc_id < F.get(ids, place)) | (doc_id == F.get(ids, place)) & further
        return F.when(place >= len(heads), False).when(place >= known, doc_id.isNull() & further).otherwise(among_ids)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(heads).bit_length()))])
    count = F.aggregate(steps, F.lit(0), lambda n, step: F.when(reached(n + step - 1), n + step).otherwise(n))
    rows = rows.withColumn("_own", F.greatest(count - 1, F.lit(0)))
    at = F.when(F.col("_own") < known, F.get(ids, "_own"))
    leads = doc_id.eqNullSafe(at) & (start == F.get(starts, "_own"))
    above = F.when(F.col("_own") == 0, len(heads)).otherwise(F.col("_own")) - 1
    own = F.struct(F.col("_own").alias("_part"), F.lit(False).alias("_guest"))
    guest = F.struct(above.alias("_part"), F.lit(True).alias("_guest"))
    places = F.when(leads, F.array(own, guest)).otherwise(F.array(own))
    return rows.select("doc_id", "_text", F.explode(places).alias("_at")).select("_at.*", "doc_id", "_text")


def beside_next(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The next document is the one with the next smaller doc_id, after the last one
    the first.  Rows of one id are ordered by their text, null ids come last.
    The edited text has the last third of its characters, rounded down, replaced
    by as many from the beginning of the next text, or all of a shorter one.
    """
    order = Window.partitionBy("_part").orderBy("_guest", F.desc_nulls_last("doc_id"), "_text")
    rows = _dealt(documents).withColumn("_next", F.lead("_text").over(order))
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - third), F.substring("_next", F.lit(1), third))
    rows = rows.withColumn("_edited", F.coalesce(edited, F.lit(""))).drop("_next")
    rows = with_fingerprint(rows, "_text", "fingerprint", size)
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint", size)
    rows = rows.withColumn("_n", n.cast("long")).withColumn("edited_sha256", F.sha2("_edited", 256)).drop("_edited")
    rows = rows.withColumn("_next_fingerprint", F.lead("fingerprint").over(order)).where(~F.col("_guest"))
    return rows.select(
        "doc_id",
        F.col("_n").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next_fingerprint").alias("near_next"),
    )
