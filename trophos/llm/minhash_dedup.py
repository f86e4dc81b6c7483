"""Near duplicates by fast similarity sketches, banding and exact verification.

A text's set is its distinct shingles of ``size`` words, A-Z in lower case.
With fewer words the whole sequence is the one element; without words (null,
empty and blank texts) the set is empty and the document is linked with nothing.
Two documents are linked if 100 * intersection >= ``percent`` * union.

1. Fast similarity sketching fills T bins: in round r every element picks a bin
   by a hash of (r, element) and offers the value r + hash; a bin keeps its
   smallest value.  From round T on, round r offers to bin r - T alone, so all
   bins are full after 2 T rounds at most, and rounds stop as soon as they are.
   Values of a later round are larger than all of an earlier one, so an early
   stop is final, and bins agree with probability equal to the Jaccard
   similarity, concentrated as for independent draws without replacement.
2. Documents with one set are one class; only its smallest id goes on.
3. Classes that agree in all ``ROWS`` bins of one of ``BANDS`` bands are
   candidates.  At similarity 0.8 a pair shares no band with probability
   (1 - 0.8 ** 7) ** 50, about 7e-6.
4. In each bucket all members are compared with its smallest id, on full sets.
   That connects a group of copies at once, with as many comparisons as members.
5. A bucket whose members are still in several components is compared across
   them.  Its members fall into blocks of about ``BLOCK``, fewer if their sets
   are large, and a task takes two blocks at a time: it gets their full sets,
   counts all intersections as a matrix product, and returns for each member the
   smallest id that links join it to, so no pairs leave the task.  Only buckets
   of unlike members need this, no task holds more than two blocks, and no
   candidate is left out.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trophos.llm import words as W
from trophos.llm.components import components
from trophos.plans.scratch import Scratch

BANDS, ROWS = 50, 7
#: Members of a block and elements of their sets, about; elements that a matrix product takes at once.
BLOCK, ELEMENTS, COLUMNS = 512, 1 << 19, 8_192


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty array of distinct 64-bit hashes.

    A value holds the round in its high 16 bits and 48 bits of the hash below.
    Rounds are taken in blocks that probably fill all bins at once; a round
    more than needed changes nothing.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, empty)
    step = max(1, round(bins * (np.log(bins) + 3) / len(elements)))
    r = 0
    while r < bins and (out == empty).any():
        rounds = np.arange(r, min(r + step, bins), dtype=np.uint64)
        h = W.mix(elements ^ W.stream((7 << 32) + r, len(rounds))[:, None])
        place = ((W.mix(h) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (h >> np.uint64(16)) | (rounds << np.uint64(48))[:, None]
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        r += len(rounds)
    for i in np.flatnonzero(out == empty):  # round bins + i is for bin i alone
        h = W.mix(elements ^ W.stream((7 << 32) + bins + i, 1)[0])
        out[i] = (h >> np.uint64(16)).min() | np.uint64(bins + i << 48)
    return out


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for s in W.slices(column):
        h = W.hashes(s)
        n = len(h)
        key = h.copy()
        for k in range(1, size):  # hash of the run of up to ``size`` words from each word
            same = np.zeros(n, bool)
            same[: max(n - k, 0)] = s.text[k:] == s.text[: max(n - k, 0)]
            ahead = np.flatnonzero(same)
            key[ahead] = W.pair_hash(key[ahead], h[ahead + k])
        first = np.searchsorted(s.text, np.arange(s.texts + 1))
        for i in range(s.texts):
            a, b = first[i], first[i + 1]
            # whole runs only, or the whole text if it is shorter
            yield np.unique(key[a : max(b - size + 1, a + 1)]) if b > a else key[:0]


def _name(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def digests(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key, bands) per row: size, name and band keys of its set; the last two are null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches = [], [], []
            for own in shingle_sets(batch["text"], size):
                n.append(len(own))
                keys.append(_name(own))
                if len(own):
                    sketches.append(sketch(own, BANDS * ROWS))
            filled = np.array(n, dtype=np.int64) > 0
            ends = np.concatenate([[0], np.cumsum(filled) * BANDS])
            bands = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(_band_keys(sketches), pa.int64()), mask=pa.array(~filled)
            )
            columns = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), bands]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n", "key", "bands"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def _band_keys(sketches: list[np.ndarray]) -> np.ndarray:
    """The keys of all bands of each sketch, one sketch after the other."""
    rows = np.array(sketches, np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(W.stream(9 << 32, BANDS), rows.shape[:2])
    for r in range(ROWS):
        key = W.pair_hash(key, rows[:, :, r])
    return np.ascontiguousarray(key).view(np.int64).ravel()


def _sets(size: int):
    """Arrow function: name and elements of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"], size))
            keys = pa.array([_name(s) for s in sets], pa.binary())
            whole = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, whole], ["key", "set"])

    return run


def _smallest(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that links reach; ``near`` tells for left and right members whether they are linked."""
    left, top = near.shape[0], len(ids)
    values, least = np.unique(ids, return_inverse=True)
    while True:
        before = least.copy()
        least[left:] = np.minimum(least[left:], np.where(near, least[:left, None], top).min(axis=0, initial=top))
        least[:left] = np.minimum(least[:left], np.where(near, least[None, left:], top).min(axis=1, initial=top))
        if (least == before).all():
            return values[least]


def _across(percent: int):
    """Arrow function of two blocks of a bucket: each member that links join to a smaller id, and the smallest.

    Intersections are those of full sets.  The result has no more rows than the
    blocks have members, however many pairs are linked.
    """

    def run(rows: pa.Table) -> pa.Table:
        block, label, n, ids = (np.asarray(rows[c]) for c in ("block", "label", "n", "id"))
        # left members come first
        order = np.argsort(block != block.min(), kind="stable")
        block, label, n, ids = block[order], label[order], n[order], ids[order]
        left = int((block == block.min()).sum())
        if left == len(block):  # one block with itself
            block, label, n, ids, order = (np.concatenate([x, x]) for x in (block, label, n, ids, order))
        sets = rows["set"].combine_chunks()
        flat, ends = np.asarray(sets.flatten()), np.asarray(sets.offsets)
        ends = ends - ends[0]
        sizes = np.diff(ends)
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        owner = np.repeat(np.arange(len(sizes)), sizes)[shared]
        column = (np.cumsum(often > 1) - 1)[column[shared]]
        both = np.zeros((left, len(block) - left), np.float32)
        for start in range(0, int((often > 1).sum()), COLUMNS):
            own = (column >= start) & (column < start + COLUMNS)
            x = np.zeros((len(sizes), COLUMNS), np.float32)
            x[owner[own], column[own] - start] = 1
            both += x[order[:left]] @ x[order[left:]].T
        both = both.astype(np.int64)
        both[order[:left][:, None] == order[left:][None, :]] = 0
        union = n[:left][:, None] + n[left:][None, :] - both
        near = (100 * both >= percent * union) & (label[:left][:, None] != label[left:][None, :])
        least = _smallest(near, ids)
        a, b = ids[ids != least], least[ids != least]
        return pa.table({"a": a, "b": b})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by comparing full sets."""
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    counted = pairs.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return counted.select("a", "b", (F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).alias("linked"))


def _merged(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after components are joined by edges between their members."""
    a = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    b = labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
    ends = edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    to = components(ends, scratch).select(F.col("id").alias("component"), F.col("component").alias("to"))
    joined = labels.join(to, "component", "left")
    return scratch.keep(joined.select("id", F.coalesce("to", "component").alias("component")))


def link(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of all candidates: the smallest id that links reach.

    ``members``: written (bucket, id, n), at least two a bucket.  ``sets``: written
    (id, set).
    """
    fits = F.least("n", "n_b") * 100 >= percent * F.greatest("n", "n_b")
    lead = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("lead"))
    lead = lead.select("bucket", F.col("lead.id").alias("b"), F.col("lead.n").alias("n_b"))
    pairs = members.join(lead, "bucket").where((F.col("id") != F.col("b")) & fits)
    found = scratch.keep(_verified(pairs.select(F.col("id").alias("a"), "b").distinct(), sets, percent))
    labels = sets.select("id", F.col("id").alias("component"))
    labels = _merged(labels, found.where("linked").select("a", "b"), scratch)

    rows = members.join(labels, "id").withColumnRenamed("component", "label")
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / ELEMENTS)
    mixed = rows.groupBy("bucket").agg(size.alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = mixed.where("x <> y").select("bucket", F.ceil("size").cast("int").alias("blocks"))
    rows = rows.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.join(sets, "id").select("bucket", "i", "j", "id", "n", "label", "block", "set")
    found = rows.groupBy("bucket", "i", "j").applyInArrow(_across(percent), "a long, b long")
    return _merged(labels, scratch.keep(found.distinct()), scratch)


def near_duplicates(documents: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, kept whether it is
    the row's own.  Texts without words are components of their own.  Ids that
    are null never name a component with other ids; where all ids are null,
    component_id is null and every row is kept.  Rows that repeat an id are
    documents of their own that happen to have the same id.
    """
    return _judged(documents, size, percent).drop("key", "component")


def _judged(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the name of each row's set and the number of its component, null without words."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.keep(digests(documents, size))
    # one row a set, numbered anew: ids may be null or repeated
    own = rows.where("key is not null").groupBy("key")
    own = own.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    own = scratch.keep(own.withColumn("id", F.monotonically_increasing_id()))
    cells = own.select("id", "n", F.posexplode("bands").alias("band", "value"))
    cells = cells.select(F.xxhash64("band", "value").alias("bucket"), "id", "n")
    shared = cells.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y")
    members = scratch.keep(cells.join(shared, "bucket", "left_semi"))
    candidates = scratch.keep(members.select("id").distinct().join(own.select("id", "key", "doc_id"), "id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d")
    wanted = candidates.select("doc_id").distinct().alias("w")
    texts = texts.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    sets = texts.mapInArrow(_sets(size), "key binary, set array<long>")
    sets = sets.join(candidates.select("key", "id"), "key").dropDuplicates(["id"]).select("id", "set")
    labels = link(members, scratch.keep(sets), percent, scratch)
    parts = own.select("id", "key", "doc_id").join(labels, "id", "left")
    parts = scratch.keep(parts.withColumn("component", F.coalesce("component", "id")).drop("id"))
    least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = parts.join(least, "component").select("key", "component", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    whole = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), "key", "component").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one of each component.

    Of the rows of one id in a component one stays, and so it does of those of one
    id and text without words: the least by text and then by the columns as JSON.
    """
    scratch = Scratch(documents.sparkSession)
    judged = scratch.keep(_judged(documents, size, percent).select("doc_id", "key", "component", "kept"))
    ids = judged.groupBy("doc_id").agg(F.count("*").alias("times"), F.max("kept").alias("kept"))
    ids = scratch.keep(ids.where("kept"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
    out = documents.alias("d").join(ids.where("times = 1").alias("k"), same, "left_semi")
    again = ids.where("times > 1")
    if not again.limit(1).count():
        return out
    # an id of several rows does not tell which of them is kept; their sets do
    name = F.arrow_udf(lambda texts: pa.array([_name(s) for s in shingle_sets(texts, size)], pa.binary()), "binary")
    rows = documents.alias("d").join(again.alias("k"), same, "left_semi")
    # the document's columns, whatever their names and types, stay together in one
    rows = rows.select(F.struct("d.*").alias("row"), F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").alias("text"))
    rows = rows.select("row", "doc_id", "text", name("text").alias("key")).alias("d")
    kept = judged.where("kept").select("doc_id", "key", "component").distinct().alias("k")
    rows = rows.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("d.key").eqNullSafe(F.col("k.key")))
    wordless = F.when(F.col("k.component").isNull(), F.coalesce(F.col("d.text"), F.lit("")))
    order = F.struct("d.text", F.to_json("d.row"))
    least = rows.groupBy(F.col("d.doc_id"), F.col("k.component"), wordless).agg(F.min_by("d.row", order).alias("row"))
    return out.unionByName(least.select("row.*"))
