"""N-gram Jaccard join (operator 3): links between documents whose sets of word shingles have a Jaccard similarity of at
least ``percent`` / 100, found by a universe-partition pigeonhole and verified exactly.

Sets.  A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, a set holds the distinct shingles of ``width`` words; a
shorter text is one shingle.  Shingles are 64-bit hashes.  Equal sets are one node (128-bit hash), however many documents
have them, so copies cost nothing further.

Pigeonhole.  Nodes are dealt into size bands; a node also enters the next band if a partner may be there.  Two linked sets
of a band differ by at most ``H`` tokens.  The band hashes tokens into segments.  A segment of kind 0 is indexed by its
subset and lost by one differing token; a segment of kind 1 is indexed by its subset and all its one-deletion neighbours and
lost only by two.  With kind 0 worth one unit and kind 1 two, ``H + T + 2 (K + F)`` units leave ``T`` common ones even if
either side drops ``K + F`` units.  Each drops ``K`` at once, its empty and smallest segments, and ``F`` more when it is known
how many sets have each signature: the most frequent ones, such as those of a passage that many documents share.  How many
segments are of which kind, and ``K``, is allocated by cost: signatures of a set, and expected collisions.

Links.  Each node is first verified against one pivot of its buckets (of the members with the largest buckets, the one that
shares most with it); in what follows only members of different components matter.  A pair is verified by its sizes, then by
small parity sketches that bound its difference from below, then exactly.  Pairs of a bucket of up to ``SMALL`` members are
verified where they share ``T`` units.  The members of a larger bucket, a passage of many documents or a family of texts just
short of the threshold, are told apart by what they differ in from the bucket's pivot: two sets differ from one another exactly
as their differences from a third do.  If neither is the pivot's own link, two linked ones have more such differences together
than they may differ in, so they share some; in an order of the differences, rarest first, those that come before the first
shared one are not shared, and so are at most as many as the two may differ in.  Just the pairs that meet in such a place are
verified.  So no link between different texts is lost, and thousands of near copies never become all their pairs.

Cases: null and empty texts have the empty set, are linked with nothing and are their own component; rows that repeat a
doc_id count by their own text each; a row with a null doc_id gets the component of its equal texts, null if it has none,
and makes no other links; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.llm.common import Memo, chunks, discard, keyed_text, pa_schema, released, slices, stored

PERCENT, WIDTH, RATIO = 85, 4, 1.35
#: Buckets of up to so many members are compared pair by pair.
SMALL = 8
#: The cost of one expected colliding pair, in signatures.
PAIR_COST = 4.0
U = np.uint64
#: The multipliers of the splitmix64 finaliser and the golden ratio in 64 bits.
M1, M2, GOLDEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


class Shingler:
    """The shingle sets of texts, as sorted 64-bit hashes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.word = Memo(xxhash.xxh3_64_intdigest, 400_000)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        return [s for part in chunks(texts) for s in self._sets(part)]

    def _sets(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.encode().lower().split() for t in texts]  # of bytes: just A-Z, and just the six ASCII spaces
        flat = np.fromiter(map(self.word.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
        with np.errstate(over="ignore"):
            rolled = [mix(flat + GOLDEN)]  # hashes of 1, 2, ... words from each place
            for k in range(1, self.width):
                rolled.append(mix(rolled[-1][: len(flat) - k] * GOLDEN + flat[k:]) if len(flat) > k else flat[:0])
        out, at = [], 0
        for w in words:
            n = len(w)
            if n >= self.width:
                out.append(np.unique(rolled[-1][at : at + n - self.width + 1]))
            else:
                out.append(rolled[n - 1][at : at + 1] if n else flat[:0])
            at += n
        return out


def most_apart(size: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of at most ``size`` tokens each."""
    return 2 * size * (100 - percent) // (100 + percent)


def allocate(h: int, size: float, rows: int) -> tuple[int, int, int, int, int]:
    """(segments of kind 1, of kind 0, units to drop at once, by frequency, units in common) at the least cost."""
    best = None
    small = h < 12  # short texts: few, long segments, all with neighbours, tell more than many short ones
    common, spare = (1, 0) if small else (1 + min(4, h // 6), -(-h // 8))
    for drop in sorted({*range(0, 9), *(round(h * x) for x in (0.05, 0.08, 0.12, 0.18, 0.25))}):
        units = h + common + 2 * (drop + spare)
        for ones in [(units + 1) // 2] if small else sorted({0, *(x for x in (1, 2, 3, units // 8, units // 4) if units - 2 * x >= 2 * spare)}):
            zeros = max(0, units - 2 * ones)
            if 2 * (ones - 1) >= units and ones > 0 or ones + zeros == 0:
                continue
            tokens = size / (ones + zeros)
            mean = zeros * math.exp(-tokens) + 2 * ones * math.exp(-tokens) * (1 + tokens)  # units that are not selective
            p, left = math.exp(-mean), mean - drop  # E[max(0, X - drop)] = mean - drop + E[max(0, drop - X)]
            for j in range(drop):
                left += (drop - j) * p
                p *= mean / (j + 1)
            left = max(left, 0.0)
            signatures = zeros + ones * (1 + tokens) - drop
            cost = signatures + PAIR_COST * left * left * rows / (ones + zeros)
            if best is None or cost < best[0]:
                best = (cost, ones, zeros, drop)
    return (*best[1:], spare, common)


class Partition:
    """Bands and their segments for a collection of about ``rows`` sets."""

    def __init__(self, rows: int, percent: int = PERCENT, ratio: float = RATIO):
        self.percent, self.rows, self.low, self.plans = percent, rows, [1], {}
        self.ratio = max(ratio, 1.15 * 100 / percent)

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.ratio)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def bands(self, n: int) -> range:
        return range(self.band(n), self.band(100 * n // self.percent) + 1)

    def plan(self, band: int) -> tuple[int, int, int, int, int] | None:
        """None: only equal sets are linked."""
        if band not in self.plans:
            self.band(self.low[-1])
            low, high = self.low[band], self.low[band + 1] - 1
            h = most_apart(high, self.percent)
            self.plans[band] = allocate(h, math.sqrt(low * high), self.rows) if h else None
        return self.plans[band]

    def signatures(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """(signatures, slot, how many of them are of kind 0) for each band; a slot holds (band, F, T)."""
        out = []
        for band in self.bands(len(tokens)):
            if (plan := self.plan(band)) is None:
                continue
            ones, zeros, drop, spare, common = plan
            with np.errstate(over="ignore"):
                mixed = mix(tokens + GOLDEN * U(2 * band + 3))
                segment = ((mixed >> U(32)) * U(ones + zeros)) >> U(32)
                order = np.argsort(segment, kind="stable")
                value, segment = mixed[order], segment[order].astype(np.int64)
                count = np.bincount(segment, minlength=ones + zeros)
                ends = np.cumsum(count)
                total = np.concatenate([np.zeros(1, U), np.cumsum(value)])
                subset = total[ends] - total[ends - count]
                salt = mix(np.arange(ones + zeros, dtype=np.uint64) + (U(band) << U(32)))
                kept = np.ones(ones + zeros, bool)
                left = drop
                few = np.flatnonzero(count[:ones] <= 1)  # their neighbours include the empty subset
                for i in few[: left // 2]:
                    kept[i] = False
                    left -= 2
                kept[ones + np.argsort(count[ones:], kind="stable")[:left]] = False
                own = mix(subset + salt)
                got = [own[ones:][kept[ones:]], own[:ones][kept[:ones]]]
                near = np.flatnonzero((segment < ones) & kept[segment])
                if len(near):
                    got.append(mix(subset[segment[near]] - value[near] + salt[segment[near]]))
            out.append((np.concatenate(got), (band << 20) + (spare << 4) + common, len(got[0])))
        return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def halves_of(sets: list[np.ndarray]) -> np.ndarray:
    """The 128-bit hash of each set as two integers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def named(halves: np.ndarray, clashes: frozenset[int]) -> np.ndarray:
    """The node of each hash: its first half, or where several sets share that, both halves mixed."""
    if not clashes:
        return halves[:, 0]
    both = mix(halves[:, 0].astype(np.uint64) ^ mix(halves[:, 1].astype(np.uint64))).astype(np.int64)
    return np.where(np.isin(halves[:, 0], list(clashes)), both, halves[:, 0])


def nodes_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, node, check): two 64-bit halves of the hash of each document's set; null without shingles."""
    ddl = f"{key} long, n_shingles long, node long, check long"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches):
        released()
        shingler = Shingler(width)
        for b in slices(batches):
            sets = shingler.sets(b.column(1).to_pylist())
            halves = halves_of(sets)
            none = np.array([not len(s) for s in sets], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(halves[:, i], mask=none) for i in (0, 1))], schema=out)

    return keyed_text(docs, key, text).mapInArrow(run, ddl)


def signatures_of(docs: DataFrame, text: str, width: int, percent: int, rows: int, clashes: frozenset[int]) -> DataFrame:
    """(sig, node, slot, units) of every set; a set that a task has met lately is not written again."""
    ddl = "sig long, node long, slot int, units int"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches):
        released()
        shingler, partition, met = Shingler(width), Partition(rows, percent), set()
        for b in slices(batches):
            sets = [s for s in shingler.sets(b.column(0).to_pylist()) if len(s)]
            sigs, nodes, slots, sizes, units = [], [], [], [], []
            for s, node in zip(sets, named(halves_of(sets), clashes).tolist()):
                if node in met:
                    continue
                if len(met) > 100_000:
                    met.clear()
                met.add(node)
                for x, slot, zeros in partition.signatures(s):
                    sigs.append(x)
                    nodes.append(node)
                    slots.append(slot)
                    sizes.append(len(x))
                    units.append(np.where(np.arange(len(x)) < zeros, 1, 2).astype(np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes)), pa.array(np.repeat(np.array(slots, np.int32), sizes)), pa.array(np.concatenate(units))], schema=out)

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, ddl)


def shared_buckets(signatures: DataFrame) -> DataFrame:
    """(sig, node, slot, units, weight) of signatures that several nodes have, without the ``F`` most frequent ones of each node
    and band.  A node's weight is how many rows its buckets have: the middle of a group of near copies weighs most."""
    by = Window.partitionBy("sig")
    some = signatures.withColumn("lo", F.min("node").over(by)).withColumn("hi", F.max("node").over(by)).where("lo <> hi").select("sig", "node", "slot", "units").distinct()
    some = stored(some.withColumn("n", F.count("*").over(by)), "signatures")  # what a few documents share
    place = F.row_number().over(Window.partitionBy("node", "slot", "units").orderBy(F.desc("n"), "sig"))
    weight = F.sum("n").over(Window.partitionBy("node", "slot"))
    kept = some.withColumn("weight", weight).withColumn("place", place).where("units = 2 OR place > (slot >> 4) & 65535").select("sig", "node", "slot", "units", "weight")
    kept = stored(kept, "buckets")
    discard(some)
    return kept


def parity_of(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls on it.  Each token that two sets do not share flips one bit at most."""
    bits = 64
    while bits < 1.3 * len(tokens):
        bits *= 2
    return np.packbits((np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_linked(x: bytes, y: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the parities differ in more bits than two linked sets of these sizes have different tokens."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):  # a place modulo half the bits
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= (na + nb) * (100 - percent) // (100 + percent)


def sets_of(docs: DataFrame, key: str, text: str, width: int, clashes: frozenset[int]) -> DataFrame:
    """(node, size, parity, tokens) of the given documents."""
    ddl = "node long, size long, parity binary, tokens binary"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches):
        released()
        shingler = Shingler(width)
        for b in slices(batches):
            sets = shingler.sets(b.column(1).to_pylist())
            nodes = named(halves_of(sets), clashes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=out)

    return keyed_text(docs, key, text).mapInArrow(run, ddl)


def joined(pairs: DataFrame, sets: DataFrame, column: str, salts: int = 16) -> DataFrame:
    """(a, b, x, y, na, nb): ``column`` and size of both; a pivot ``a`` of many pairs is spread over several keys."""
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col(column).alias("y")), "b").withColumn("salt", salt)
    pivots = pairs.select("a", salt.alias("salt")).distinct().join(sets.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col(column).alias("x")), "a")
    return right.join(pivots, ["a", "salt"]).select("a", "b", "x", "y", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of (a, b) that are linked: by size, then by parity, then by the sets themselves."""
    out = pa_schema(pairs.sparkSession, "a long, b long")

    def kept(pairs: DataFrame, column: str, test) -> DataFrame:
        def run(batches):
            for b in slices(batches):
                yes = [test(*row) for row in zip(*(b.column(c).to_pylist() for c in ("x", "y", "na", "nb")))]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=out).filter(pa.array(yes, pa.bool_()))

        return joined(pairs, sets, column).mapInArrow(run, "a long, b long")

    size = nodes.select("node", "size")
    fits = stored(pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), "pairs")
    close = stored(kept(fits, "parity", lambda x, y, na, nb: may_be_linked(x, y, na, nb, percent)), "pairs")
    edges = stored(kept(close, "tokens", lambda x, y, na, nb: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)), "edges")
    discard(fits, close)
    return edges


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, diff): the tokens that just one of a pivot ``a`` and a node ``b`` has, those of ``b`` first."""
    ddl = "a long, b long, na long, nb long, diff array<long>"
    out = pa_schema(pairs.sparkSession, ddl)

    def run(batches):
        for b in slices(batches):
            diff = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                diff += np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
            ends = np.concatenate([[0], np.cumsum([len(d) for d in diff])])[::2]
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(diff)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), flat], schema=out)

    return joined(pairs, sets, "tokens").mapInArrow(run, ddl)


def apart_alike(apart: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes in different components that may be linked, by their differences from a common pivot.

    Differences are ordered: those that a node has come before those that it lacks, and those that many nodes of the pivot share
    come last, the most shared ones at the end.  Any fixed order loses nothing, so a sample of the nodes tells which these are.  Of two nodes, one has at most
    half as many differences before the first shared one as the two may differ in; such rows are joined with all.
    """
    some = apart.where(F.pmod(F.xxhash64("b"), F.lit(8)) == 0)
    usual = some.select("a", F.explode("diff").alias("token")).groupBy("a", "token").agg(F.count("*").alias("n")).join(some.groupBy("a").agg(F.count("*").alias("of")), "a")
    usual = usual.where("n > 1 AND 32 * n >= of").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("usual"))  # at most 32 times the mean difference
    rows = apart.join(usual, "a", "left").withColumn("usual", F.coalesce(F.col("usual.token"), F.array().cast("array<long>")))
    first = F.slice(F.concat(F.array_except("diff", "usual"), F.array_intersect("usual", "diff")), F.lit(1), F.floor(F.col("nb") * (100 - percent) / percent).cast("int") + 1)
    rows = rows.select("a", F.col("b").alias("n"), F.col("nb").alias("size"), F.posexplode(first).alias("at", "token"))
    held = stored(rows.join(comps, F.col("n") == F.col("node"), "left").select("a", "token", "n", "size", "at", F.coalesce("comp", "n").alias("comp")), "differences")
    few = held.where(f"2 * {percent} * at <= {100 - percent} * size").toDF("a1", "token1", "n1", "size1", "at1", "comp1")
    meet = F.expr(f"a = a1 AND token = token1 AND comp <> comp1 AND {100 + percent} * (at + at1) <= {100 - percent} * (size + size1) AND 100 * least(size, size1) >= {percent} * greatest(size, size1)")
    return few.join(held, meet).select(F.least("n", "n1").alias("a"), F.greatest("n", "n1").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of all nodes with an edge (a, b): the smallest node reachable, by alternating large and small stars."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        spent, now = now, stored(small, name)
        discard(spent)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first())
        if new == mark and new[0] == new[2]:  # a forest of stars that no longer changes
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        mark = new


def links(docs: DataFrame, nodes: DataFrame, percent: int, width: int, key: str, text: str, clashes: frozenset[int]) -> DataFrame | None:
    """(node, comp) of the nodes that are linked with others."""
    # the partition is set by the order of magnitude of the collection
    rows = 1 << max(10, nodes.count().bit_length())
    by = Window.partitionBy("sig")
    buckets = shared_buckets(signatures_of(docs, text, width, percent, rows, clashes))
    first = buckets.withColumn("pivot", F.max(F.struct("weight", "node")).over(by)["node"]).where("pivot <> node").groupBy("node", "pivot").agg(F.sum("units").alias("n"))
    # one pivot for each node: the one with most in common
    chosen = stored(first.groupBy("node").agg(F.max(F.struct("n", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("node").alias("b")), "pairs")
    if chosen.isEmpty():
        return None
    involved = buckets.select("node").distinct().join(nodes, "node").select(F.col("rep").alias(key))
    sets = stored(sets_of(docs.where(F.col(key).isNotNull()).join(involved, key, "left_semi"), key, text, width, clashes).dropDuplicates(["node"]), "sets")
    edges = verified(chosen, sets, nodes, percent)
    comps = components(edges)
    held = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(nodes.select("node", "size"), "node")
    held = held.withColumn("lo", F.min("comp").over(by)).withColumn("hi", F.max("comp").over(by)).where("lo <> hi").drop("lo", "hi")
    held = stored(held.withColumn("members", F.count("*").over(by)), "buckets")
    discard(buckets)
    small, large = held.where(F.col("members") <= SMALL), held.where(F.col("members") > SMALL)
    mine = small.select("sig", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("size").alias("na"), "slot", "units")
    theirs = small.select("sig", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("nb"))
    meet = mine.join(theirs, "sig").where(f"a < b AND comp_a <> comp_b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    found = meet.groupBy("a", "b", "slot").agg(F.sum("units").alias("n")).where("n >= slot & 15").select("a", "b")
    # the pivot of a bucket is the one that most of its members were verified against, so a node has few of them
    large = large.join(chosen.toDF("own", "node"), "node", "left").withColumn("own", F.coalesce("own", "node")).withColumn("votes", F.count("*").over(Window.partitionBy("sig", "own")))
    large = large.withColumn("a", F.max(F.struct("votes", "own")).over(by)["own"])
    pivots = stored(large.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    apart = stored(differences(pivots, sets), "differences")
    direct = apart.where(f"{100 + percent} * size(diff) <= {100 - percent} * (na + nb)").select("a", "b")
    found = stored(found.union(apart_alike(apart, comps, percent)).distinct(), "pairs")
    return components(edges.union(direct).union(verified(found, sets, nodes, percent)))


def ngram_join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the smallest key reachable by links."""
    rows = stored(nodes_of(docs, key, text, width), "nodes")
    alike = rows.where(F.col("node").isNotNull())
    # sets with equal first halves of their hashes: 1 expected among 6 billion sets
    clashes = frozenset(r.node for r in alike.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("node").collect())
    if clashes:
        both = F.udf(lambda a, b: int(named(np.array([[a, b]], np.int64), clashes)[0]), "long")
        alike = alike.withColumn("node", F.when(F.col("node").isin(list(clashes)), both("node", "check")).otherwise(F.col("node")))
    nodes = stored(alike.groupBy("node").agg(F.min(key).alias("rep"), F.min("n_shingles").alias("size")), "nodes")
    # one document signs for all with its set; keys that repeat with different sets all sign
    copies = stored(alike.join(nodes, "node").groupBy(key).agg(F.min(F.col(key) > F.col("rep")).alias("copy")).where("copy").select(key), "copies")
    comps = links(docs.join(copies, key, "left_anti"), nodes, percent, width, key, text, clashes)
    if comps is None:
        whole = nodes.select("node", F.col("rep").alias("component_id"))
    else:
        of = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
        whole = of.join(least, "comp").select("node", "component_id")
    found = alike.join(whole, "node").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
    return found.union(rows.where(F.col("node").isNull()).select(key, "n_shingles", F.col(key).alias("component_id")))


def representatives(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole: of each component the first by key (null last) and row order, and all rows without shingles.

    Keys may repeat or be null, so rows are numbered and the numbers are joined.
    """
    held = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    found = ngram_join(held.select("row", F.col("doc")[text].alias("text")), percent, width, "row", "text")
    keys = held.select("row", F.col("doc")[key].cast("long").alias("key"))
    first = found.join(keys, "row").groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("row")))["row"].alias("row"))
    return held.join(first, "row", "left_semi").select("doc.*")


def brute(texts: dict[int, str | None], percent: int = PERCENT, width: int = WIDTH) -> dict[int, tuple[int, int]]:
    """key -> (n_shingles, component_id) by comparing all pairs of a small collection; for tests."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in texts}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}
