"""Token counts that follow edits without encoding the text again.

A document keeps a segment tree over its pre-tokens.  A leaf is a run of up to
``LEAF`` words cut where a pre-token always begins, at a space that a non-space
follows, so leaves can be encoded one by one; a node holds the characters and
tokens below it.  An edit goes down the tree to the leaves it touches.  If their
new text does not begin with such a place, the leaf before joins them as context;
what follows begins with one and is not affected.  The joined text alone is
encoded again, and the sums above it are updated.

Edits of a document are applied in order, each in characters (code points) of
the text as the edits before left it.  Positions beyond the text are moved to its
end; a null or negative start or length counts as 0, a null text is empty.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trophos.llm.bpe import Encoder, encoder

LEAF = 32
EDITS = "array<struct<start: long, removed: long, inserted: string>>"

_CUT = re.compile(r" (?=\S)")
_BEGINS = re.compile(r" \S")


def leaves_of(text: str) -> list[str]:
    """The text in runs of up to LEAF words."""
    at = [m.start() for m in _CUT.finditer(text)][LEAF - 1 :: LEAF]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


class TokenTree:
    """Segment tree over the leaves of one text; ``counts`` saves encoding them."""

    def __init__(self, tokens: Encoder, text: str, counts: list[int] | None = None, texts: list[str] | None = None):
        self.tokens = tokens
        texts = leaves_of(text) if texts is None else texts
        self._build(texts, [self._encoded(t) for t in texts] if counts is None else counts)

    def _encoded(self, text: str) -> int:
        return len(self.tokens.encode(text)) // 4

    def _build(self, texts: list[str], counts: list[int]) -> None:
        self.texts, self.size = texts, 1 << (max(len(texts), 1) - 1).bit_length()
        rest = [0] * (self.size - len(texts))
        self.chars = [0] * self.size + [len(t) for t in texts] + rest
        self.sums = [0] * self.size + counts + rest
        for node in range(self.size - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def counts(self) -> list[int]:
        return self.sums[self.size : self.size + len(self.texts)]

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at ``place``, and its offset there; at the end, the last leaf."""
        if place >= self.n_chars:
            last = len(self.texts) - 1
            return last, len(self.texts[last])
        node = 1
        while node < self.size:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.size, place

    def edit(self, start: int, removed: int, inserted: str) -> int:
        """Replace characters; returns how many characters were encoded again."""
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(removed, 0), self.n_chars)
        first, offset = self._find(start)
        last = max(first, self._find(stop)[0])
        region = "".join(self.texts[first : last + 1])
        region = region[:offset] + inserted + region[offset + stop - start :]
        while first and region and not _BEGINS.match(region):
            first -= 1
            region = self.texts[first] + region
        parts = leaves_of(region)
        counts = [self._encoded(p) for p in parts]
        places = last + 1 - first
        if len(parts) > places:  # more leaves than before: a new tree over all, of which only these are encoded
            own = self.counts
            self._build(self.texts[:first] + parts + self.texts[last + 1 :], own[:first] + counts + own[last + 1 :])
            return len(region)
        parts += [""] * (places - len(parts))
        counts += [0] * (places - len(counts))
        for leaf, (text, count) in enumerate(zip(parts, counts), first):
            self.texts[leaf] = text
            self.chars[self.size + leaf], self.sums[self.size + leaf] = len(text), count
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for node in range(low, high + 1):
                self._add_up(node)
            low, high = low // 2, high // 2
        return len(region)


def _edited(tree: TokenTree, edits) -> int:
    whole = lambda x: max(int(x or 0), 0)
    return sum(tree.edit(whole(e["start"]), whole(e["removed"]), e["inserted"] or "") for e in edits or () if e)


def build_trees(documents: DataFrame, path: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_chars, n_tokens, and the leaves' characters and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            trees = [TokenTree(tokens, text.as_py() or "") for text in batch["text"]]
            columns = [
                pa.array([t.n_chars for t in trees], pa.int64()),
                pa.array([t.n_tokens for t in trees], pa.int64()),
                pa.array([[len(x) for x in t.texts] for t in trees], pa.list_(pa.int64())),
                pa.array([t.counts for t in trees], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_chars", "n_tokens", "leaf_chars", "leaf_tokens"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, leaf_chars array<long>, leaf_tokens array<long>")


def recount(rows: DataFrame, path: str) -> DataFrame:
    """Counts before and after edits.

    ``rows``: doc_id, text, edits, and leaf_chars and leaf_tokens of a kept tree;
    where these are null the tree is built first.  Returns doc_id, n_tokens,
    edited_chars, edited_tokens, encoded_again (characters), and the new leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, sizes = row["text"] or "", row["leaf_chars"]
                texts = None
                if sizes is not None:
                    ends = [0]
                    for n in sizes:
                        ends.append(ends[-1] + n)
                    texts = [text[a:b] for a, b in zip(ends, ends[1:])]
                tree = TokenTree(tokens, text, row["leaf_tokens"], texts)
                before = tree.n_tokens
                again = _edited(tree, row["edits"])
                out.append((row["doc_id"], before, tree.n_chars, tree.n_tokens, again, [len(t) for t in tree.texts], tree.counts))
            long, longs = pa.int64(), pa.list_(pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, (long, long, long, long, long, longs, longs))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "edited_chars", "edited_tokens", "encoded_again", "leaf_chars", "leaf_tokens"]
    source = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"), "leaf_chars", "leaf_tokens"
    )
    return source.mapInArrow(run, ", ".join(f"{n} {'long' if 'leaf' not in n else 'array<long>'}" for n in names))


def with_edits(documents: DataFrame, each: int = 3) -> DataFrame:
    """``each`` edits per document at places that follow from its id: words removed, a few put in."""

    def edit(k: int):
        spin = lambda i, n: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k), F.lit(i)), n)
        return F.struct(
            spin(0, F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("start"),
            spin(1, F.lit(48)).cast("long").alias("removed"),
            F.concat(F.lit(" edited "), spin(2, F.lit(1000)).cast("string"), F.lit(" text")).alias("inserted"),
        )

    none = F.lit(None).cast("array<long>")
    return documents.select(
        "doc_id", "text", F.array(*[edit(k) for k in range(each)]).alias("edits"), none.alias("leaf_chars"), none.alias("leaf_tokens")
    )
