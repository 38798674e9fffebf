"""Token counts (operator 9): the tokenizer as a deterministic transducer whose transitions carry token counts.

Compilation.  After reading a prefix of a pretoken, all that the future depends on is, for each place where a token may
still be open, the trie node that the bytes since then have reached, the last token of the encoding up to there, and how
many tokens that encoding has less than the encoding up to here.  This tuple is a state.  Reading a byte moves every open
place along the trie; the one place whose completed token is compatible with the token before it ends the encoding of the
longer prefix, and the change of its token count is written on the transition.  The tuples are finitely many.  States and
transitions are made when first reached and kept in a table, as lazy automata do; the count of a pretoken is the sum along
its path.

Whole texts.  ``Machine`` puts the rules for pretokens in front of it: a transducer over characters whose state is the kind
of the open pretoken (letters, digits, others, white space, an apostrophe that may begin a contraction) and the state above.
What it emits is the change in the number of tokens of the text read so far, so the counts of a text are a sum along its path.

Composition.  A long text is cut into blocks of fixed size anywhere, and the blocks are dealt over the cluster.  Each becomes
a map from entry states to (exit state, count), for the live ones: where a pretoken surely ends in the ``LOOK`` characters
before the block, just one state is possible; else those that are reached from each of the first ``STARTS`` places there,
which meet soon or have the period of the text.  Maps compose associatively, in a tree of pairs, to the map of the text.  A
block whose entry is not sure carries its text along, so that a state that was not expected extends its map: the count is
exact in any case.  Inside a block only what stands before the first and after the last sure end of a pretoken depends on
states; what lies between is summed chunk by chunk from a memo, as in short texts.

Cases: null and empty texts have 0 tokens; a special string in a text is one token; texts without any white space,
repeated rows and extra columns make no difference.
"""

from __future__ import annotations

from ast import literal_eval

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.bpe import CHUNKS, PRETOKENS, SPACE, Vocabulary
from srcquarry.llm.common import Memo, held, keyed_text, map_rows, pa_schema, slices

#: Characters of a block, those looked at before it, and how many of these a path may start from.
BLOCK, LOOK, STARTS = 1 << 16, 1 << 10, 64
#: Where a pretoken ends whatever came before: before white space, and where kinds change, but not after an apostrophe.
SURE = rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=\p{{L}})(?=[^{SPACE}\p{{L}}])|(?<=\p{{N}})(?=[^{SPACE}\p{{N}}])|(?<=[^{SPACE}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])"
FIRST_SURE, LAST_SURE = regex.compile(SURE), regex.compile("(?r)" + SURE)
KINDS = regex.compile(rf"(?P<W>[{SPACE}])|(?P<L>\p{{L}})|(?P<N>\p{{N}})|(?P<O>.)", regex.DOTALL)
EMPTY = ((0, -1, 0),)
START = ("", EMPTY, "")


class Transducer:
    """Counts BPE tokens of a pretoken byte by byte."""

    def __init__(self, path: str, limit: int = 3_000_000):
        self.vocab = v = Vocabulary(path)
        self.limit = limit
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token: list[int] = [-1]
        for b, i in v.ids.items():
            node = 0
            for x in b:
                nxt = self.child.get(node << 8 | x)
                if nxt is None:
                    nxt = self.child[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        self.states, self.ids, self.step = [EMPTY], {EMPTY: 0}, {}

    def extend(self, state: int, byte: int) -> int:
        """Make the transition; next state << 8 | emitted + 128."""
        fits, opened, last, count = self.vocab.compatible, [], -1, 0
        for node, before, n in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            opened.append((node, before, n))
            token = self.token[node]
            if last < 0 and token >= 0 and (before < 0 or fits[before << 20 | token]):
                last, count = token, n + 1
        opened.append((0, last, count))
        nxt = tuple((node, before, n - count) for node, before, n in opened)
        to = self.ids.get(nxt)
        if to is None:
            to = self.ids[nxt] = len(self.states)
            self.states.append(nxt)
        made = self.step[state << 8 | byte] = to << 8 | count + 128
        return made

    def feed(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """(state, emitted count) after ``data``, from any state."""
        if len(self.step) > self.limit:
            self.reset()
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        n, step = 0, self.step
        for byte in data:
            made = step.get(at << 8 | byte)
            if made is None:
                made = self.extend(at, byte)
            at = made >> 8
            n += (made & 255) - 128
        return self.states[at], n

    def count(self, data: bytes) -> int:
        return self.feed(EMPTY, data)[1]


class Machine:
    """The transducer over characters.  States: (kind, transducer's state, rest).

    In white space (W) the rest is the last character, which the state does not hold yet: it may belong to the next word.
    After an apostrophe (') the rest is the letter that may go on as a contraction.
    """

    def __init__(self, dfa: Transducer):
        self.dfa = dfa
        self.kind = Memo(lambda c: KINDS.match(c).lastgroup, 20_000)
        self.moves = Memo(lambda key: self.move(*key), 100_000)

    def feed(self, state: tuple, text: str) -> tuple[tuple, int]:
        return self.dfa.feed(state, text.encode())

    def count(self, text: str) -> int:
        return self.feed(EMPTY, text)[1]

    def begin(self, c: str, before: str = "") -> tuple[tuple, int]:
        """The first character of a pretoken, with the space that belongs to it."""
        kind = self.kind[c]
        if kind == "W":
            return ("W", EMPTY, c), self.count(c)
        if c == "'" and not before:
            return ("'", EMPTY, ""), self.count(c)
        state, n = self.feed(EMPTY, before + c)
        return (kind, state, ""), n

    def move(self, state: tuple, c: str) -> tuple[tuple, int]:
        mode, inner, rest = state
        kind = self.kind[c]
        if mode == "W":
            longer, n = self.feed(inner, rest)
            if kind == "W":
                return ("W", longer, c), self.feed(longer, c)[1]
            to, more = self.begin(c, " " if rest == " " else "")
            return to, more - n + (0 if rest == " " else self.count(rest))
        if mode == "'":
            if rest + c in ("s", "t", "m", "d", "re", "ve", "ll"):
                return START, self.count("'" + rest + c) - 1 - len(rest)
            if rest and kind == "L":
                inner, mode = self.feed(EMPTY, rest)[0], "L"
            elif not rest and c in ("r", "v", "l"):
                return ("'", EMPTY, c), 1
            elif not rest and kind == "O":
                inner, mode = self.feed(EMPTY, "'")[0], "O"
        if mode != kind:
            return self.begin(c)
        inner, n = self.feed(inner, c)
        return (kind, inner, ""), n

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        n = 0
        for c in text:
            state, k = self.moves[state, c]
            n += k
        return state, n


class Map:
    """{entry state: (exit state, count)} of a stretch of text; entry None: whatever it is."""

    def __init__(self, of: dict, run=None):
        self.of, self.run = of, run

    def at(self, state: str) -> tuple[str, int]:
        got = self.of.get(None) or self.of.get(state)
        if got is None:  # not expected: extended
            got = self.of[state] = self.run(state)
        return got

    def then(self, other: Map) -> Map:
        def run(state):
            to, n = self.at(state)
            end, k = other.at(to)
            return end, n + k

        return Map({s: run(s) for s in self.of}, run)


def composed(maps: list[Map]) -> Map:
    """The map of all, by pairs of neighbours."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    def __init__(self, path: str, block: int = BLOCK, look: int = LOOK):
        self.dfa, self.block, self.look = Transducer(path), block, look
        self.machine = Machine(self.dfa)
        self.pretokens = regex.compile(PRETOKENS)
        self.chunk = Memo(lambda c: sum(self.dfa.count(p.encode()) for p in self.pretokens.findall(c)), 1_500_000)

    def run(self, text: str) -> int:
        return sum(map(self.chunk.__getitem__, CHUNKS.findall(text)))

    def count(self, text: str) -> int:
        """Of a text that is not cut."""
        special = self.dfa.vocab.special
        return sum(1 if part in special else self.run(part) for part in self.dfa.vocab.parts(text))

    def blocks(self, text: str):
        """(at, sure, before, block, n) in turn; n is 1 if the block is a special string; sure: ``before`` begins a text."""
        at = 0
        for part in self.dfa.vocab.parts(text):
            if part in self.dfa.vocab.special:
                yield at, True, "", part, 1
                at += 1
                continue
            for i in range(0, len(part), self.block):
                yield at, i <= self.look, part[max(0, i - self.look) : i], part[i : i + self.block], 0
                at += 1

    def entries(self, sure: bool, before: str) -> list[tuple] | None:
        """The live states before a block; one, if it is sure."""
        m = LAST_SURE.search(before)
        if m or sure:
            return [self.machine.run(START, before[m.start() :] if m else before)[0]]
        live = set()
        for i, c in enumerate(before):
            live = {self.machine.moves[s, c][0] for s in [*live, *([START] if i < STARTS else [])]}
        return sorted(live)

    def through(self, state: tuple, block: str) -> tuple[tuple, int]:
        first = FIRST_SURE.search(block)
        if first is None:
            return self.machine.run(state, block)
        a, b = first.start(), LAST_SURE.search(block).start()
        end, n = self.machine.run(START, block[b:])
        return end, self.machine.run(state, block[:a])[1] + self.run(block[a:b]) + n

    def map_of(self, sure: bool, before: str, block: str) -> tuple[list[tuple], str | None]:
        """([(entry, exit, count)], the block itself if its entry is not sure)."""
        sure = sure or LAST_SURE.search(before) is not None
        live = self.entries(sure, before)
        return [(None if sure else repr(s), repr(end), n) for s in live for end, n in [self.through(s, block)]], None if sure else block

    def total(self, maps: list[tuple[list[tuple], str | None]]) -> int:
        """The count of a text from the maps of its blocks."""

        def extended(block):
            def run(state):
                end, n = self.through(literal_eval(state), block)
                return repr(end), n

            return run

        return composed([Map({s: (end, n) for s, end, n in of}, extended(block)) for of, block in maps]).at(repr(START))[1] if maps else 0


def counter(path: str, block: int = BLOCK, look: int = LOOK) -> Counter:
    """One per Python worker, kept between tasks."""
    return held(("counts", path, block, look), lambda: Counter(path, block, look))


CUT = "row long, {key} long, at int, sure boolean, before string, block string, n long"
MAP = "row long, {key} long, at int, n long, n_bytes long, of array<struct<entry: string, exit: string, n: long>>, block string"


def long_counts(texts: DataFrame, path: str, block: int, look: int, key: str, text: str) -> DataFrame:
    """(key, n_bytes, n_tokens) of texts of more than one block: blocks in parallel, then the maps of each text."""
    spark = texts.sparkSession
    cut, maps, out = (pa_schema(spark, ddl.format(key=key)) for ddl in (CUT, MAP, "{key} long, n_bytes long, n_tokens long"))

    def cuts(batches):
        c = counter(path, block, look)
        for b in slices(batches, 1):
            (row,), (k,), (t,) = (x.to_pylist() for x in b.columns)
            rows = []
            for x in c.blocks(t):
                rows.append((row, k, *x))
                if len(rows) == 64:
                    yield of_rows(rows, cut)
                    rows = []
            if rows:
                yield of_rows(rows, cut)

    def mapped(batches):
        c = counter(path, block, look)
        for b in slices(batches, 64):
            rows = []
            for row, k, at, sure, before, piece, n in zip(*(x.to_pylist() for x in b.columns)):
                of, kept = c.map_of(sure, before, "" if n else piece)
                rows.append((row, k, at, n, len(piece.encode()), [dict(zip(("entry", "exit", "n"), o)) for o in of], kept))
            yield of_rows(rows, maps)

    def totals(batches):
        c = counter(path, block, look)
        for b in slices(batches, 1):
            for k, size, n, found in zip(*(x.to_pylist() for x in b.columns)):
                yield of_rows([(k, size, n + c.total([([(o["entry"], o["exit"], o["n"]) for o in m["of"]], m["block"]) for m in found]))], out)

    rows = texts.select(F.monotonically_increasing_id().alias("row"), key, text)
    pieces = rows.mapInArrow(cuts, CUT.format(key=key)).repartition("row", "at").mapInArrow(mapped, MAP.format(key=key))
    # of each block a few states: far less than the text, which is one row itself
    whole = pieces.groupBy("row", key).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "of", "block"))).alias("found"))
    return whole.select(key, "n_bytes", "n", "found").mapInArrow(totals, f"{key} long, n_bytes long, n_tokens long")


def of_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", block: int = BLOCK, look: int = LOOK) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text; those of more than ``block`` characters are counted block by block."""

    def start():
        c = counter(path, block, look)
        return lambda keys, texts: {key: keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [c.count(t) for t in texts]}

    texts = keyed_text(docs, key, text)
    short = map_rows(texts.where(F.length(text) <= block), f"{key} long, n_bytes long, n_tokens long", start, key, text)
    counted = short.unionByName(long_counts(texts.where(F.length(text) > block), path, block, look, key, text))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
