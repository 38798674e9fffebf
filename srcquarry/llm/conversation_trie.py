"""Conversation prefix trie (operator 11): succinct level-order tries for each prefix shard, heavy upper levels apart.

A node is a distinct sequence of first turns (role, text).  Its name while rows travel is the exclusive-or of 64-bit hashes
of (depth, 128-bit digest of the turn) over its turns, two of them, so that a prefix of any length is 16 bytes and the name
of the parent follows from it.  Steps:

1. ``ordered_turns`` numbers the turns of each conversation; ``running`` names the prefix that ends at each turn.
2. One aggregation by name gives every node with its members, and ``weight``: the turns of all members from it on.
3. A node that weighs more than ``shard_rows`` is heavy; the light nodes whose parent is heavy head the shards, so a shard
   has at most ``shard_rows`` nodes.  Each task lays out the shards it is dealt as one LOUDS forest (a bitvector of unary
   degrees in level order, arrays of labels) and rolls leaves and saved bytes up in reverse order with ``np.add.at``.
4. The heavy nodes, with the sums of the shards below, are laid out the same way in bands of levels, deepest first, each of
   at most ``band_rows`` nodes (one level alone needs no trie and may be of any size).

Cases: null roles and texts are empty; turns of one conversation are ordered by turn (nulls first), then role, then text;
turns without a conversation id belong to no conversation; equal rows are turns of their own; a very long conversation is
spread by ``running``; an empty table gives no node at all; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import discard, pa_schema, stored
from srcquarry.llm.sequences import joined_sha256, running

NAME, PARENT = ["hi", "lo"], ["up_hi", "up_lo"]
#: What the tries are laid out from, and what comes back.
NODE = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, n_convs long, n_ends long"
IN = f"{NODE}, n_bytes long, below_children long, below_leaves long, below_saved long"
OUT = f"{NODE}, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"
#: Up to so many heavy nodes (some MB) go to every executor.
SMALL = 50_000


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, digest, n_bytes) of every turn; positions are 1, 2, ... by turn."""
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = F.octet_length("role").cast("string")
    digest = F.unhex(F.md5(F.concat(size, F.lit(":"), F.col("role"), F.col("text")))).alias("digest")
    keep = ["conv_id", digest, F.octet_length("text").cast("long").alias("n_bytes")]
    return running(t, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], keep, {}, "turns")


def with_borrowed_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations c whose first h turns are those of conversation c - c % 5, h = crc32(c) % 9: (rows with depth, plan).

    All turns of the lender if it has fewer, none if there is no such conversation; then the own turns after the first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    c = F.col("conv_id")
    plan = lengths.select("conv_id", (c - c % 5).alias("lender"), (F.crc32(c.cast("string")) % 9).cast("long").alias("h"))
    lent = lengths.select(c.alias("lender"), "n")
    plan = plan.join(lent, "lender", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0).cast("long")))).drop("n")
    plan = stored(plan, "plan")
    heads = turns.where("position <= 8").withColumnRenamed("conv_id", "lender").join(plan, "lender").where("position <= h")
    own = turns.join(plan, "conv_id").where("position > h")
    rows = heads.select("conv_id", F.col("position").alias("depth"), "digest", "n_bytes").unionByName(
        own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_bytes")
    )
    return rows, plan


class Louds:
    """A forest in level order: for a super-root and then for each node, a one for each child and a zero."""

    def __init__(self, parents: np.ndarray):
        """``parents`` in level order, -1 for roots: never falling, since siblings stand together."""
        self.n = len(parents)
        degrees = np.bincount(parents + 1, minlength=self.n + 1)
        bits = np.ones(2 * self.n + 1, np.uint8)
        bits[np.cumsum(degrees + 1) - 1] = 0
        self.bits = np.packbits(bits)

    def unary(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n + 1)

    def degrees(self) -> np.ndarray:
        """Children of the super-root, then of each node."""
        return np.diff(np.flatnonzero(self.unary() == 0), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Zeros before the i-th one name the parent of node i."""
        return np.flatnonzero(self.unary()) - np.arange(self.n) - 1

    def levels(self) -> list[tuple[int, int]]:
        before = np.concatenate([[0], np.cumsum(self.degrees())])  # nodes that come before the children of each
        out, a, b = [], 0, int(before[1])
        while a < b:
            out.append((a, b))
            a, b = b, int(before[b + 1])
        return out


def level_order(names: np.ndarray, parents: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nodes in level order, and the places of their parents in that order (-1: not among them)."""
    n = len(depth)
    both = np.concatenate([names, parents])
    order = np.lexsort((both[:, 1], both[:, 0]))
    step = np.any(both[order][1:] != both[order][:-1], axis=1)
    dense = np.empty(2 * n, np.int64)
    dense[order] = np.concatenate([[0], np.cumsum(step)])
    at = np.full(2 * n, -1)
    at[dense[:n]] = np.arange(n)
    up = at[dense[n:]]
    up[up == np.arange(n)] = -1  # the root of all names itself as its parent
    # children of each node as runs, for a walk level by level
    by_parent = np.lexsort((names[:, 1], names[:, 0], up))
    first = np.searchsorted(up[by_parent], np.arange(-1, n))
    count = np.diff(np.append(first, n))
    out, level = [], np.array([-1])
    while True:
        begin, size = first[level + 1], count[level + 1]
        total = int(size.sum())
        if not total:
            break
        level = by_parent[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]
        out.append(level)
    placed = np.concatenate(out) if out else np.zeros(0, np.int64)
    place = np.full(n + 1, -1)
    place[placed] = np.arange(n)
    return placed, place[up[placed]]


def rolled_up(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns OUT (parents by index) of the nodes IN, laid out as one LOUDS forest."""
    placed, parents = level_order(np.stack([c["hi"], c["lo"]], 1), np.stack([c["up_hi"], c["up_lo"]], 1), c["depth"])
    c = {k: v[placed] for k, v in c.items()}
    trie = Louds(parents)
    parents = trie.parents()
    children = trie.degrees()[1:] + c["below_children"]
    leaves = c["below_leaves"] + (children == 0)
    saved = c["below_saved"] + (c["n_convs"] - 1) * c["n_bytes"]
    for a, b in reversed(trie.levels()[1:]):
        np.add.at(leaves, parents[a:b], leaves[a:b])
        np.add.at(saved, parents[a:b], saved[a:b])
    return c | {"n_children": children, "n_leaves": leaves, "saved_tokens": saved, "parent": parents}


def laid_out(nodes: DataFrame, shard: list[str], most: int) -> DataFrame:
    """OUT of nodes IN; shards are whole in a partition and are laid out together up to ``most`` nodes or one shard."""
    out = pa_schema(nodes.sparkSession, OUT)
    names = [f.split()[0] for f in IN.split(", ")]

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        c = rolled_up({k: t.column(k).to_numpy() for k in names})
        up = c["parent"]
        c |= {"top": up < 0, "parent_conv_id": pa.array(c["conv_id"][up], mask=up < 0)}
        return pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) for f in out], schema=out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            s = np.stack([b.column(k).to_numpy() for k in shard], 1) if shard else np.zeros((b.num_rows, 1))
            starts = np.flatnonzero(np.concatenate([[last is None or bool(np.any(s[0] != last))], np.any(s[1:] != s[:-1], axis=1)]))
            last, begin = s[-1], 0
            for at in starts:  # before a shard that would lead beyond the limit, what is held is made
                if n + (at - begin) and n + at - begin >= most:
                    held.append(b.slice(begin, at - begin))
                    yield made(held)
                    held, n, begin = [], 0, int(at)
            held.append(b.slice(begin))
            n += b.num_rows - begin
        if n:
            yield made(held)

    return nodes.select(*names, *shard).mapInArrow(run, OUT)


def totals(placed: DataFrame) -> DataFrame:
    """What the tops of tries bring to their parents."""
    sums = [F.count("*").alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved")]
    return placed.where("top").groupBy(*PARENT).agg(*sums).withColumnsRenamed(dict(zip(PARENT, NAME)))


def bands(levels: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of depths, deepest first, of at most ``most`` nodes or one level."""
    out: list[list[int]] = []
    n = 0
    for depth in sorted(levels, reverse=True):
        if not out or n + levels[depth] > most:
            out.append([depth, depth])
            n = 0
        out[-1][0] = depth
        n += levels[depth]
    return [tuple(x) for x in out]


def prefix_trie(turns: DataFrame, ids: DataFrame, shard_rows: int = 1 << 18, band_rows: int = 1 << 20) -> DataFrame:
    """All nodes of the trie over (conv_id, depth, digest, n_bytes), ``ids`` also naming conversations without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is known by its
    smallest member and its depth.
    """
    spark = turns.sparkSession
    none = F.lit(0).cast("long")
    named = turns.withColumn("a", F.xxhash64("digest", "depth")).withColumn("b", F.xxhash64("depth", "digest"))
    prefixes = running(named, "conv_id", [F.col("depth")], ["conv_id", "depth", "n_bytes", "a", "b"], {"hi": "a", "lo": "b"}, "prefixes")
    rows = prefixes.withColumn("up_hi", F.col("hi").bitwiseXOR(F.col("a"))).withColumn("up_lo", F.col("lo").bitwiseXOR(F.col("b"))).drop("a", "b")
    lengths = stored(ids.distinct().join(rows.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id", "left"), "lengths")

    nodes = rows.join(lengths, "conv_id").groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"),
        *(F.max(c).alias(c) for c in ("depth", "n_bytes", *PARENT)),
        F.count("*").alias("n_convs"),
        F.count_if(F.col("depth") == F.col("n")).alias("n_ends"),
        F.sum(F.col("n") - F.col("depth") + 1).alias("weight"),
    )
    nodes = stored(nodes, "nodes")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("n").isNull()).alias("n_ends"))
    root = root.where("n_convs > 0").withColumns(dict.fromkeys(["depth", "n_bytes", *NAME, *PARENT], none))

    heavy = nodes.where(F.col("weight") > shard_rows).drop("weight")
    levels = {r.depth: r["count"] for r in heavy.groupBy("depth").count().collect()}
    few = sum(levels.values()) <= SMALL
    # the first light depth of each conversation, and the name of its node there
    if levels:
        on = heavy.select(*NAME)
        above = rows.where(F.col("depth") <= max(levels)).join(F.broadcast(on) if few else on, NAME, "left_semi")
        cut = above.groupBy("conv_id").agg((F.count("*") + 1).alias("cut"))
        heads = rows.join(cut, "conv_id", "left").where(F.col("depth") == F.coalesce("cut", F.lit(1)))
    else:
        heads = rows.where("depth = 1")
    heads = heads.select("conv_id", F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"))
    light = nodes.where(F.col("weight") <= shard_rows).join(heads, "conv_id").withColumns(dict.fromkeys(["below_children", "below_leaves", "below_saved"], none))
    light = light.repartition("s_hi", "s_lo").sortWithinPartitions("s_hi", "s_lo", "depth")
    placed = [stored(laid_out(light, ["s_hi", "s_lo"], shard_rows), "shards")]

    upper = heavy.unionByName(root, allowMissingColumns=True).join(totals(placed[0]), NAME, "left").withColumns({c: F.coalesce(c, none) for c in ("below_children", "below_leaves", "below_saved")})
    upper = stored(upper, "upper")
    for first, last in bands({**levels, 0: 1}, band_rows):
        band = upper.where(F.col("depth").between(first, last))
        if len(placed) > 1:
            more = totals(placed[-1]).withColumnsRenamed({c: f"more_{c}" for c in ("below_children", "below_leaves", "below_saved")})
            band = band.join(more, NAME, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", none) for c in ("below_children", "below_leaves", "below_saved")})
        band = band.repartition(1) if first < last else band.repartition(*NAME)
        placed.append(stored(laid_out(band, [], band_rows), "band"))

    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    # parents of the tops of tries are heavy
    top = F.col("top")
    known = upper.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("heavy_parent"))
    tops = every.where(top).join(F.broadcast(known) if few else known, PARENT, "left")
    tops = tops.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("heavy_parent"))).drop("heavy_parent")
    every = every.where(~top).unionByName(tops)

    ended = rows.join(lengths.withColumnRenamed("n", "depth"), ["conv_id", "depth"], "left_semi").select(*NAME, "conv_id")
    ended = ended.unionByName(lengths.where("n IS NULL").select(none.alias("hi"), none.alias("lo"), "conv_id"))
    # ids of 4,096 numbers as one text, so that rows of a node that very many end at are few
    texts = ended.groupBy(*NAME, F.shiftright("conv_id", 12).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = joined_sha256(texts, NAME, "block", "ids", ",")
    out = every.join(ends, NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
    out = stored(out, "trie")
    discard(prefixes, nodes, lengths, upper, *placed)
    return out


def borrowed_heads_trie(conversations: DataFrame, shard_rows: int = 1 << 18, band_rows: int = 1 << 20) -> DataFrame:
    """``prefix_trie`` of conversations with ``with_borrowed_heads``."""
    turns = ordered_turns(conversations)
    rows, plan = with_borrowed_heads(turns)
    out = prefix_trie(rows, plan.select("conv_id"), shard_rows, band_rows)
    discard(turns, plan)
    return out
