"""Benchmark decontamination (operator 6): a BM25 inverted index of the test items, queried by every training passage.

Index.  Terms are words in lower case without punctuation at their ends.  A posting holds an item and the term's BM25
impact, divided by the score that the item's own text gets, so that 1 is the item itself.  Posting lists are ordered by
item and cut into blocks with their largest impact.  Items are indexed by length band (16 words, then twice as many).

Query.  Each text is cut into passages of twice its band's length, beginning every band's length, so that an item of the
band lies whole within one of them.  An upper bound discards most passages at once: an item gets no more than the impacts
of its rare terms that stand in the passage, and all its frequent terms, whose sum is at most ``FREQUENT``.  For the rest,
block-max WAND finds all items above the threshold, skipping blocks that cannot reach it.  Both work on whole Arrow batches
of texts, so numpy's fixed cost is shared.

Verification.  An item's question is its text up to the last question mark or line break within it, else the first half;
the rest is its answer; halves also where either would have fewer than three words.  A hit counts if enough of the word triples of both stand in the passage.

The index is built from about ``shard`` bytes of items at a time and broadcast; a larger benchmark takes several passes over the
texts, each with its own part of the items.  Document frequencies, item counts and mean lengths are those of the whole
benchmark in every pass, and scores are summed exactly, so the result does not depend on the number of passes.  A pass is
finished and its index released before the next.

Short items.  An item with fewer than ``least`` words is no matter of scores: it is found where its whole word sequence stands
in a text, by hashes of all stretches of its length, which are then compared word by word.  Its score and overlaps are 1.

Cases: null or empty texts and items, and items of punctuation only, match nothing; a null item_id is reported as null; items that repeat an id are one; the result has one row for each document and item, the best passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import Memo, chunks, keyed_text, map_rows, released, slices, stored

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
BLOCK = 16
LEAST = 8
#: Of an item's score, what its most frequent terms may sum up to; the bound below looks at the others only.
FREQUENT = 0.3
#: Bounds are summed in any order; this is more than they may round.
SLACK = 1e-9


def terms(text: str) -> list[str]:
    return [EDGES.sub("", w) for w in text.lower().split()]


def triples(words: list) -> set[tuple]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    body = text.strip()
    cut = max(body.rfind("?", 0, -1) + 1, body.rfind("\n"))
    if cut > 0 and min(len(body[:cut].split()), len(body[cut:].split())) >= 3:
        return terms(body[:cut]), terms(body[cut:])
    words = terms(body)
    return words[: len(words) // 2], words[len(words) // 2 :]


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` ids in a row."""
    count, out = max(0, len(ids) - n + 1), np.uint64(0)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + count].astype(np.uint64)
    return out


def band_of(words: list) -> int:
    length = 16
    while length < len(words):
        length *= 2
    return length


class Stats(NamedTuple):
    """What BM25 needs to know of all items of a band: how many, their words, and in how many of them each term stands."""

    items: int
    words: int
    df: dict[str, int]


class Band:
    """Inverted index of items of one length band; ``stats`` are those of the whole benchmark, by default of ``items``."""

    def __init__(self, items: list[tuple[int, list[str], list[str], list[str]]], length: int, term: dict[str, int], common: Counter, stats: Stats | None = None, k1: float = 1.2, b: float = 0.75):
        self.length, self.items = length, [i for i, *_ in items]
        counts = [Counter(w for w in words if w) for _, words, _, _ in items]
        stats = stats or Stats(len(items), sum(len(words) for _, words, _, _ in items), Counter(w for c in counts for w in c))
        df, mean = stats.df, stats.words / stats.items
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for n, c in enumerate(counts):
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            impact = {w: math.log(1 + (stats.items - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + norm) for w, f in c.items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                lists[term[w]].append((n, x / whole))
        self.docs = {t: [n for n, _ in x] for t, x in lists.items()}
        self.impacts = {t: [x for _, x in y] for t, y in lists.items()}
        self.block_last = {t: [d[min(k + BLOCK, len(d)) - 1] for k in range(0, len(d), BLOCK)] for t, d in self.docs.items()}
        self.block_max = {t: [max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for t, x in self.impacts.items()}
        self.most = {t: max(x) for t, x in self.impacts.items()}
        # essential terms of each item, rarest first, and the sum of the rest
        self.rest, pairs = np.zeros(len(items)), []
        for n, c in enumerate(counts):
            got = {term[w]: self.impacts[term[w]][bisect_left(self.docs[term[w]], n)] for w in c}
            left = FREQUENT
            for t in sorted(got, key=lambda t: (-common[t], t)):
                if left is not None and got[t] <= left:
                    left -= got[t]
                    self.rest[n] += got[t]
                else:
                    left = None
                    pairs.append((t, n, got[t]))
        pairs.sort()
        self.many = np.bincount([t for t, _, _ in pairs], minlength=len(term) + 1)  # the last is for words that no item has
        self.first = np.cumsum(self.many) - self.many
        self.item, self.impact = np.array([n for _, n, _ in pairs], np.int64), np.array([x for _, _, x in pairs])
        number = lambda words: [term.get(w, -1) for w in words]
        self.question = [triples(number(q)) for _, _, q, _ in items]
        self.answer = [triples(number(a)) for _, _, _, a in items]

    def wand(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of ``least`` or more."""
        docs, impacts, most, last, block = self.docs, self.impacts, self.most, self.block_last, self.block_max
        at = {t: 0 for t in query}
        live = sorted(query, key=lambda t: docs[t][0])
        out = []
        while live:
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += most[t]
                if bound >= least - SLACK:
                    pivot = docs[t][at[t]]
                    break
            if pivot is None:
                return out
            while k + 1 < len(live) and docs[live[k + 1]][at[live[k + 1]]] == pivot:
                k += 1
            head = live[: k + 1]
            # blocks that hold the pivot
            where = [bisect_left(last[t], pivot, at[t] // BLOCK) for t in head]
            if sum(block[t][j] for t, j in zip(head, where) if j < len(last[t])) >= least - SLACK:
                to = pivot
                if docs[live[0]][at[live[0]]] == pivot:
                    score = math.fsum(impacts[t][at[t]] for t in head)
                    if score >= least:
                        out.append((pivot, score))
                    to = pivot + 1
            else:  # no item up to the nearest block end can reach it
                ends = [last[t][j] for t, j in zip(head, where) if j < len(last[t])]
                to = min(ends, default=pivot) + 1
                if k + 1 < len(live):
                    to = min(to, docs[live[k + 1]][at[live[k + 1]]])
                to = max(to, pivot + 1)
            for t in head:
                if docs[t][at[t]] < to:
                    at[t] = bisect_left(docs[t], to, at[t])
            live = sorted((t for t in live if at[t] < len(docs[t])), key=lambda t: docs[t][at[t]])
        return out


    def promising(self, ids: np.ndarray, starts: np.ndarray, base: np.ndarray, count: int, least: float) -> np.ndarray:
        """Of the ``count`` passages of all texts, numbered on from ``base`` of their text, those that some item may reach."""
        if self.rest.max(initial=0.0) >= least - SLACK:  # frequent terms alone may do
            return np.arange(count)
        at = np.flatnonzero(self.many[ids])
        of = np.searchsorted(starts, at, "right") - 1
        k = (at - starts[of]) // self.length
        inner = k > 0  # a word stands in the passage that begins in its stretch and in the one before
        terms, width = ids[at], len(self.many)
        key = np.unique(np.concatenate([(base[of] + k) * width + terms, (base[of] + k - 1)[inner] * width + terms[inner]]))
        passage, term = key // width, key % width
        n = self.many[term]
        posting = np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, where = np.unique(np.repeat(passage, n) * len(self.items) + self.item[posting], return_inverse=True)
        bound = np.bincount(where, self.impact[posting], len(pair)) + self.rest[pair % len(self.items)]
        return np.unique(pair[bound >= least - SLACK] // len(self.items))


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, overlap: float = 0.6, least: int = LEAST, stats: dict[int, Stats] | None = None):
        self.threshold, self.overlap = threshold, overlap
        bands, short = defaultdict(list), []
        for i, text in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
            words = terms(text or "")
            if len(words) >= least:
                bands[band_of(words)].append((i, words, *question_answer(text)))
            elif any(words):
                short.append((i, words))
        self.term: dict[str, int] = {"": 0}  # punctuation only: in no posting list, and not the same as an unknown word
        common: Counter = Counter()
        for x in bands.values():
            for _, words, _, _ in x:
                for w in dict.fromkeys(words):
                    if w:
                        common[self.term.setdefault(w, len(self.term))] += 1
        #: number of words -> hash -> (item, words)
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, words in short:
            ids = np.array([self.term.setdefault(w, len(self.term)) for w in words], np.int64)
            self.short[len(words)][int(windows(ids, len(words))[0])].append((i, words))
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.bands = [Band(x, n, self.term, common, stats and stats[n]) for n, x in sorted(bands.items())]
        self.memo = None

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, float, float, float]]]:
        """For each text (item, first word of the passage, score, question overlap, answer overlap), the best passage of each item."""
        return [h for part in chunks(texts) for h in self._hits(part)]

    def _hits(self, texts: list[str]) -> list[list[tuple[int, int, float, float, float]]]:
        if self.memo is None:  # made in the worker
            self.memo = Memo(lambda w: self.term.get(EDGES.sub("", w), -1), 400_000)
        words = [t.lower().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for n, known in self.short.items():
            hashes = windows(ids, n)
            for at in np.flatnonzero(np.isin(hashes, np.array(list(known), np.uint64))).tolist():
                of = int(np.searchsorted(starts, at, "right")) - 1
                begin = at - int(starts[of])
                stretch = [EDGES.sub("", w) for w in words[of][begin : begin + n]]
                for i, item in known[int(hashes[at])]:
                    if stretch == item:
                        best[of].setdefault(i, (1.0, -begin, 1.0, 1.0))
        for band in self.bands:
            stretches = -(-sizes // band.length)
            base = np.cumsum(stretches) - stretches
            for k in band.promising(ids, starts, base, int(stretches.sum()), self.threshold).tolist():
                of = int(np.searchsorted(base, k, "right")) - 1
                begin = (k - int(base[of])) * band.length
                passage = ids[starts[of] + begin : starts[of] + min(begin + 2 * band.length, int(sizes[of]))].tolist()
                found = band.wand([t for t in dict.fromkeys(passage) if t in band.docs], self.threshold)
                there = triples(passage) if found else ()
                for n, score in found:
                    q, a = (len(x & there) / len(x) for x in (band.question[n], band.answer[n]))
                    if q >= self.overlap and a >= self.overlap:
                        hit = (round(float(score), 6), -begin, round(q, 4), round(a, 4))
                        best[of][band.items[n]] = max(best[of].get(band.items[n], hit), hit)
        return [[(i, -b, s, q, a) for i, (s, b, q, a) in sorted(x.items(), key=lambda y: (y[0] is not None, y[0] or 0))] for x in best]


def counted(items: DataFrame, item: str, text: str, least: int = LEAST) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """((band, term, df, parts) of all items, ``parts`` those in which the term stands; band -> (items, words))."""

    def run(batches):
        for b in batches:
            out = {"band": [], "part": [], "words": [], "terms": []}
            for part, t in zip(b.column("part").to_pylist(), b.column(text).to_pylist()):
                words = terms(t)
                if len(words) >= least:
                    for k, x in zip(out, (band_of(words), part, len(words), list({w for w in words if w}))):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["band"], pa.int64()), pa.array(out["part"], pa.int64()), pa.array(out["words"], pa.int64()), pa.array(out["terms"], pa.list_(pa.string()))], names=list(out))

    held = stored(items.select("part", text).mapInArrow(run, "band long, part long, words long, terms array<string>"), "items")
    sizes = {r.band: (r.n, r.words) for r in held.groupBy("band").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    each = held.select("band", "part", F.explode("terms").alias("term"))
    return stored(each.groupBy("band", "term").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")), "terms"), sizes


def indexes(benchmark: DataFrame, size: int, item: str, text: str, threshold: float, overlap: float) -> Iterator[tuple[Broadcast, bool]]:
    """(broadcast index, whether it is the only one): each part of the benchmark in turn, the one before released."""
    sc = benchmark.sparkSession.sparkContext
    held = benchmark.select(F.col(item).cast("long").alias(item), F.coalesce(F.col(text), F.lit("")).alias(text))
    n = max(1, math.ceil((held.agg(F.sum(F.octet_length(text))).first()[0] or 0) / size))
    if n == 1:
        yield sc.broadcast(Index([tuple(r) for r in held.collect()], threshold, overlap)), True
        return
    held = held.withColumn("part", F.pmod(F.xxhash64(item), F.lit(n)))
    counts, sizes = counted(held, item, text)
    for k in range(n):
        stats = {band: Stats(*x, {}) for band, x in sizes.items()}
        for r in counts.where(F.array_contains("parts", F.lit(k).cast("long"))).select("band", "term", "df").toLocalIterator():
            stats[r.band].df[r.term] = r.df
        index = sc.broadcast(Index([tuple(r) for r in held.where(F.col("part") == k).drop("part").collect()], threshold, overlap, stats=stats))
        del stats
        yield index, False
        index.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard: int = 16 << 20, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item_id, passage_start, score, question_overlap, answer_overlap): every verified hit of every text."""
    out = None
    ddl = f"{key} long, hits array<struct<item_id: bigint, passage_start: bigint, score: double, question_overlap: double, answer_overlap: double>>"
    for index, only in indexes(benchmark, shard, item, "text", threshold, overlap):

        def start(index=index):
            released()
            x = index.value

            def work(keys, texts):
                rows = [(k, h) for k, h in zip(keys, x.hits(texts)) if h]
                return {key: [k for k, _ in rows], "hits": [[dict(zip(("item_id", "passage_start", "score", "question_overlap", "answer_overlap"), h)) for h in r] for _, r in rows]}

            return work

        found = map_rows(keyed_text(docs, key, text), ddl, start, key, text).select(key, F.inline("hits"))
        if only:
            return found
        found = stored(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard: int = 16 << 20, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs``, whole, that no item leaks into; rows with a null text stay."""
    at, held, gone = docs.columns.index(text), None, None
    for index, only in indexes(benchmark, shard, item, "text", threshold, overlap):

        def run(batches, index=index):
            released()
            x = index.value
            for b in slices(batches):
                yield b.filter(pa.array([not h for h in x.hits([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

        def marked(batches, index=index):
            released()
            x = index.value
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([bool(h) for h in x.hits([t or "" for t in b.column(1).to_pylist()])], pa.bool_()))], names=["row"])

        if only:
            return docs.mapInArrow(run, docs.schema)
        if held is None:  # ids may be null or repeat: rows are numbered, once
            held = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
        found = stored(held.select("row", F.col("doc")[text].alias("text")).mapInArrow(marked, "row long"), "leaking")
        gone = found if gone is None else gone.unionByName(found)
    return held.join(gone, "row", "left_anti").select("doc.*")
