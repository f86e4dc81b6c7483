"""Trie of the prefixes that rebuilt conversations share.

A conversation c is rebuilt from the first h turns of its base, c - c % 100 (the
remainder as in SQL, towards zero), and its own turns after its first h;
h = crc32(decimal c) % 6.  Turns are in the order of ``turn``, null first; turns
of equal number in the order of role and text.  A null role or text is empty.
Repeated rows are turns of their own.  Rows without conv_id are left out, and an
empty table has no node.  Other columns are not looked at.

A sequence of turns has the fingerprint (n, v): its length, and in each of four
lanes the sum of turn * BASE ** place modulo a prime.  Fingerprints form a monoid,
(n, v) (m, w) = (n + m, v + BASE ** n * w), so that the prefixes of a rebuilt
conversation are made of its base's head and its own suffix without its texts:

    own suffix from h   BASE ** -h * (v(own prefix) - v(first h))
    rebuilt             v(head) + BASE ** n(head) * v(own suffix)

The same product joins the pieces of a long conversation, which may lie in many
sorted partitions: no task gets a whole one.  Members of a node are the rows of
one depth and fingerprint.  They are equal if, at every depth, all of them have
one last turn and one parent, which is verified on the stored turns; turns, in
turn, are compared in full.  Two unequal sequences of one fingerprint make the
work start again with other hashes.

The smallest member of a node owns it.  Once a conversation owns a node it owns
all below it on its own path, so sums over a subtree are sums over members: the
owner adds what it owns from the node on, every other member all that it owns.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trophos.plans.scratch import Scratch

PRIME = 2147483647
#: A base of powers for each lane.
BASES = (1103515245, 1299709317, 1566083941, 1812433253)
#: Longest head that conversations are rebuilt from.
HEAD = 5
#: Ids that are joined to one string; depths that one window sums.
IDS, DEPTHS = 1 << 16, 1 << 12
NODE = ["depth", "f0", "f1"]


class FingerprintClash(RuntimeError):
    """Unequal sequences with one fingerprint."""


def build(conversations: DataFrame, prime: int = PRIME, attempts: int = 3) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for seed in range(attempts):
        try:
            scratch = Scratch(conversations.sparkSession)
            members = scratch.keep(rebuilt_prefixes(conversations, scratch, seed, prime), "members")
            return _described(_nodes(members, scratch), members, scratch)
        except FingerprintClash:
            continue
    raise FingerprintClash(f"{attempts} sets of hashes clash")


# --- fingerprints -------------------------------------------------------------


def _power(lane: int, exponent: str, prime: int) -> str:
    """SQL of BASE ** exponent, by the bits of the exponent."""
    squares = [BASES[lane] % prime]
    while len(squares) < 40:
        squares.append(squares[-1] * squares[-1] % prime)
    table = f"array({', '.join(f'{s}L' for s in squares)})"
    step = f"if(getbit({exponent}, b) = 1, a * element_at({table}, b + 1) % {prime}L, a)"
    return f"aggregate(sequence(0, length(bin({exponent})) - 1), 1L, (a, b) -> {step})"


def _lane(i: int, prime: int) -> str:
    """SQL of the turn as a number in a lane: a half of one of its two hashes."""
    half = f"t{i // 2} & 2147483647L" if i % 2 else f"shiftrightunsigned(t{i // 2}, 33)"
    return f"(({half}) % {prime}L)"


def _packed(lanes: list[str], names: tuple[str, str]) -> list[Column]:
    """Four lanes of 31 bits in two numbers."""
    return [F.expr(f"shiftleft({lanes[2 * k]}, 31) | ({lanes[2 * k + 1]})").alias(n) for k, n in enumerate(names)]


def stored_turns(conversations: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """Written (row, conv_id, t0, t1, chars): turns in order, numbered by partition; verified hashes of role and text."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    # the beginning of a text keeps the bounds of the ranges small
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    hashes = [F.xxhash64(F.lit(2 * seed + i), "role", "text").alias(f"t{i}") for i in (0, 1)]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "conv_id", *hashes, "role", "text")
    rows = scratch.keep(rows, "turns")
    distinct = rows.select("t0", "t1", "role", "text").distinct().groupBy("t0", "t1").count()
    if not distinct.where("count > 1").isEmpty():
        raise FingerprintClash("turns")
    return rows.select("row", "conv_id", "t0", "t1", F.length("text").alias("chars"))


def own_prefixes(turns: DataFrame, scratch: Scratch, prime: int) -> DataFrame:
    """Written (conv_id, pos, t0, t1, chars, v0..v3, u0..u3): the fingerprint with and without each turn."""
    turns = turns.withColumn("part", F.shiftrightunsigned("row", 33))
    piece = Window.partitionBy("conv_id", "part").orderBy("row")
    local = turns.withColumn("place", F.row_number().over(piece).cast("long"))
    terms = [F.expr(f"{_lane(i, prime)} * {_power(i, 'place', prime)} % {prime}L").alias(f"x{i}") for i in range(4)]
    local = local.select("*", *terms)
    local = local.select("*", *[(F.sum(f"x{i}").over(piece) % prime).alias(f"s{i}") for i in range(4)])
    local = scratch.keep(local, "local")
    # the pieces before each piece, composed; a conversation in one piece has none
    pieces = local.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), *[(F.sum(f"x{i}") % prime).alias(f"p{i}") for i in range(4)]
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = pieces.select("*", *[F.expr(_power(i, "at", prime)).alias(f"b{i}") for i in range(4)])
    sums = [(F.sum(F.expr(f"p{i} * b{i} % {prime}L")).over(before) % prime).alias(f"q{i}") for i in range(4)]
    pieces = pieces.select("conv_id", "part", "at", *[f"b{i}" for i in range(4)], *sums).where("at > 0")
    rows = local.join(pieces, ["conv_id", "part"], "left")
    composed = "if(at is null, {0}, (q{1} + b{1} * ({0})) % {2}L) as {3}{1}"
    with_turn = [composed.format(f"s{i}", i, prime, "v") for i in range(4)]
    without = [composed.format(f"pmod(s{i} - x{i}, {prime}L)", i, prime, "u") for i in range(4)]
    rows = rows.selectExpr("conv_id", "coalesce(at, 0) + place as pos", "t0", "t1", "chars", *with_turn, *without)
    return scratch.keep(rows, "own")


def _splices(own: DataFrame, scratch: Scratch, prime: int) -> DataFrame:
    """Written, per conversation: h, taken (turns of the head), length, head (turns of the base), c0..c3, m0..m3.

    A prefix of the rebuilt conversation that ends with an own turn has c + m * v in each lane.
    """
    turn = F.struct("pos", "t0", "t1", "chars", *[f"v{i}" for i in range(4)])
    first = F.array_sort(F.collect_list(F.when(F.col("pos") <= HEAD, turn)))
    convs = scratch.keep(own.groupBy("conv_id").agg(F.max("pos").alias("n"), first.alias("first")), "convs")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % (HEAD + 1)).cast("int").alias("h")
    heads = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    rows = convs.select("conv_id", base, h, "n", "first").join(heads, "base", "left")
    rows = rows.withColumn("base_first", F.coalesce("base_first", F.slice("first", 1, 0)))
    taken = F.least("h", F.size("base_first"))
    rows = rows.withColumn("taken", taken).withColumn("head", F.slice("base_first", 1, F.col("taken")))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    columns = []
    for i in range(4):
        back = pow(BASES[i] % prime, -1, prime) if BASES[i] % prime else 0
        powers = f"array({', '.join(f'{pow(back, k, prime)}L' for k in range(HEAD + 1))})"
        m = f"element_at({powers}, h - taken + 1)"
        before = f"if(taken > 0, get(head, taken - 1).v{i}, 0L)"
        skipped = f"coalesce(if(h > 0, get(first, h - 1).v{i}, 0L), 0L)"
        columns += [F.expr(f"pmod({before} - {m} * {skipped} % {prime}L, {prime}L)").alias(f"c{i}"), F.expr(m).alias(f"m{i}")]
    return scratch.keep(rows.select("conv_id", "h", "taken", length.alias("length"), "head", *columns), "splices")


def rebuilt_prefixes(conversations: DataFrame, scratch: Scratch, seed: int = 0, prime: int = PRIME) -> DataFrame:
    """A row per rebuilt conversation and depth from 0: conv_id, depth, f0, f1, g0, g1 (its parent's), t0, t1, chars, is_end."""
    own = own_prefixes(stored_turns(conversations, scratch, seed), scratch, prime)
    splices = _splices(own, scratch, prime)
    end = lambda depth: (depth == F.col("length")).alias("is_end")
    zero = F.lit(0).cast("long")
    names = ["conv_id", "depth", "f0", "f1", "g0", "g1", "t0", "t1", "chars", "is_end"]

    root = splices.select("conv_id", *[zero] * 8, end(zero)).toDF(*names)

    head = splices.select("conv_id", "length", "head", F.posexplode("head").alias("i", "turn"))
    at = [f"turn.v{i}" for i in range(4)]
    before = [f"if(i > 0, get(head, i - 1).v{i}, 0L)" for i in range(4)]
    depth = F.col("turn.pos")
    fingerprints = [*_packed(at, ("f0", "f1")), *_packed(before, ("g0", "g1"))]
    head = head.select("conv_id", depth, *fingerprints, "turn.t0", "turn.t1", "turn.chars", end(depth))

    rows = own.join(splices.drop("head"), "conv_id").where("pos > h")
    at, before = ([f"((c{i} + m{i} * {name}{i}) % {prime}L)" for i in range(4)] for name in "vu")
    depth = F.col("pos") - F.col("h") + F.col("taken")
    fingerprints = [*_packed(at, ("f0", "f1")), *_packed(before, ("g0", "g1"))]
    rows = rows.select("conv_id", depth, *fingerprints, "t0", "t1", "chars", end(depth))
    return root.union(head.toDF(*names)).union(rows.toDF(*names))


# --- nodes --------------------------------------------------------------------


def _nodes(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Written: a row per node with its owner, verified."""
    same = ["t0", "t1", "g0", "g1"]
    nodes = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count(F.when(F.col("is_end"), 1)).alias("n_ends"),
        F.max("chars").alias("chars"),
        *[F.min(c).alias(c) for c in same],
        *[F.max(c).alias(f"{c}_max") for c in same],
    )
    clash = " or ".join(f"{c} <> {c}_max" for c in same)
    nodes = nodes.select(
        *NODE, "conv_id", "n_convs", "n_ends", "g0", "g1", F.expr(clash).alias("clash"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    nodes = scratch.keep(nodes, "nodes")
    if not nodes.where("clash").isEmpty():
        raise FingerprintClash("prefixes")
    return nodes.drop("clash")


def _described(nodes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    owners = scratch.keep(
        nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("owned"), F.max(leaf).alias("leaf")),
        "owners",
    )
    rows = members.select(*NODE, "conv_id", "is_end").join(owners, "conv_id", "left")
    elsewhere = F.when(F.col("top") > F.col("depth"), F.col("owned"))
    child = F.when(~F.col("is_end") & (F.col("top") <= F.col("depth") + 1), 1)
    sums = rows.groupBy(*NODE).agg(
        F.coalesce(F.sum(elsewhere), F.lit(0)).alias("elsewhere"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        F.count(child).alias("n_children"),
    )
    # a node's parent has another owner where the owner's path begins
    tops = nodes.join(owners.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).where("depth > 0")
    tops = tops.select("conv_id", F.col("depth").alias("at"), (F.col("depth") - 1).alias("depth"), F.col("g0").alias("f0"), F.col("g1").alias("f1"))
    parents = tops.join(nodes.select(*NODE, F.col("conv_id").alias("parent")), NODE).select(
        "conv_id", F.col("at").alias("depth"), "parent"
    )
    out = _from_here_on(nodes).join(sums, NODE).join(parents, ["conv_id", "depth"], "left")
    out = out.join(_hashed_ends(members), NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("elsewhere") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _from_here_on(nodes: DataFrame) -> DataFrame:
    """``below``: what the owner saves from each of its nodes on, summed in blocks of depths."""
    nodes = nodes.withColumn("block", F.floor(F.col("depth") / DEPTHS))
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("whole"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("whole").over(later), F.lit(0)).alias("later"))
    own = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    rows = nodes.withColumn("own", F.sum("saved").over(own)).join(blocks, ["conv_id", "block"])
    return rows.select(*NODE, "conv_id", "n_convs", (F.col("own") + F.col("later")).alias("below"))


def _hashed_ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, in order.

    Ids are sorted and joined in pieces of a range of ids, so that the one task
    that a hash takes reads a node's pieces and never sorts or holds its ids.
    """
    ends = members.where("is_end").groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("piece"))
    ends = ends.agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = ends.select(*NODE, "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return pieces.mapInArrow(_hash_pieces, "depth long, f0 long, f1 long, ends string")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state, found = None, None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*NODE, "ids")]
        for *key, ids in zip(*columns):
            if key == node:
                state.update(b",")
            else:
                if node:
                    found.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield _hash_batch(found)
        found = []
    if node:
        yield _hash_batch([(*node, state.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*NODE, "ends"])
