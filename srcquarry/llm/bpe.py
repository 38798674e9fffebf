"""BPE encoding and decoding (operator 10): a backtracking encoder and an offset-table decoder.

Encoding.  An Aho-Corasick automaton over the vocabulary finds, in one pass over a pretoken, the longest token that
starts at each byte.  Tokens are then laid from left to right.  A token may follow its left neighbour only if the pair is
compatible: merging the bytes of both from scratch gives just these two tokens.  A sequence of pairwise compatible
tokens that covers the pretoken is the one that the merge rules produce, so the first full cover is the answer.  If a
token does not fit, the next shorter token that is its prefix is tried; if none is left, the position is marked as a dead
end and the left neighbour is shortened instead.  Each position dies at most once: linear time.

Decoding.  All token bytes lie in one array; an offset table gives each token's slice, and numpy gathers the slices.

Cases: a null or empty text gives no ids; a special string inside a text is its special id, as the library does by
default; lone very long words are encoded without being remembered; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import re
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcquarry.llm.common import Memo, held, keyed_text, map_rows, pa_schema, slices

#: The pretoken pattern of byte-level BPE vocabularies and the white space of Unicode.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0  -     　"

#: White space and what follows up to the next white space: no pretoken crosses the end of such a chunk.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as byte strings, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = {t: bytes(of[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.compatible = Compatible(self)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition, used for pairs and in tests."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((m[0], k, m[1]) for k, p in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(p))), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def parts(self, text: str):
        """The text between special strings, and the special strings, in turn."""
        return self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else (text,)


class Compatible(dict):
    """The pair-compatibility table, filled as pairs come up: left << 20 | right -> may right follow left."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, pair: int) -> bool:
        left, right = pair >> 20, pair & 0xFFFFF
        if len(self) >= 400_000:
            self.clear()
        ok = self[pair] = self.vocab.merge(self.vocab.bytes[left] + self.vocab.bytes[right]) == [left, right]
        return ok


class Codec:
    def __init__(self, path: str):
        self.vocab = v = Vocabulary(path)
        self.match = ahocorasick.Automaton()
        for b, i in v.ids.items():
            self.match.add_word(b.decode("latin-1"), (i, len(b)))
        self.match.make_automaton()
        self.whole = {b.decode("latin-1"): i for b, i in v.ids.items()}
        self.length = [len(b) for b in v.bytes]
        self.shorter = [-1] * len(v.bytes)  # the longest token that is a proper prefix of this one
        for b, i in v.ids.items():
            self.shorter[i] = next((v.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in v.ids), -1)
        self.flat = np.frombuffer(b"".join(v.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.pretokens = regex.compile(PRETOKENS)
        self.chunk = Memo(self._chunk, 300_000)

    def _chunk(self, chunk: str) -> bytes:
        ids = array("I")
        for piece in self.pretokens.findall(chunk):
            ids.extend(self.piece(piece.encode().decode("latin-1")))
        return ids.tobytes()

    def piece(self, s: str) -> list[int]:
        """The ids of one pretoken, given as its bytes in latin-1."""
        if (i := self.whole.get(s)) is not None:
            return [i]
        longest = [0] * len(s)
        for end, (i, n) in self.match.iter(s):
            longest[end - n + 1] = i  # ends ascend, so the last one is the longest
        length, shorter, fits, end = self.length, self.shorter, self.vocab.compatible, len(s)
        dead = bytearray(end + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            to = at + length[token]
            if not dead[to] and (not out or fits[out[-1] << 20 | token]):
                out.append(token)
                if to == end:
                    return out
                at, token = to, longest[to]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        special = self.vocab.special
        return b"".join(special[p].to_bytes(4, "little") if p in special else b"".join(map(self.chunk.__getitem__, CHUNKS.findall(p))) for p in self.vocab.parts(text))

    def decode(self, ids: bytes) -> str:
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(a):
            return ""
        lo, n = self.offsets[a], self.offsets[a + 1] - self.offsets[a]
        shift = np.repeat(lo - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One per Python worker, kept between tasks."""
    return held(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the ids of every text, little-endian unsigned 32-bit."""

    def start():
        c = codec(path)
        return lambda keys, texts: {key: keys, "ids": [c.encode(t) for t in texts]}

    return map_rows(keyed_text(docs, key, text), f"{key} long, ids binary", start, key, text)


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, text) of (key, ids binary); null ids are an empty text."""

    def start():
        c = codec(path)
        return lambda keys, rows: {key: keys, "text": [c.decode(r or b"") for r in rows]}

    return map_rows(ids.select(key, column), f"{key} long, text string", start, key, column)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and give digests of both: (key, n_tokens, ids_sha256, decoded_sha256)."""

    def start():
        c = codec(path)

        def work(keys, texts):
            ids = [c.encode(t) for t in texts]
            back = [c.decode(i) for i in ids]
            return {key: keys, "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back]}

        return work

    return map_rows(keyed_text(docs, key, text), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string", start, key, text)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text replaced by its ids, their number, and digests of the ids and of what they decode to.

    Columns of ``docs`` that have the name of a new one are replaced by it.
    """
    import pyarrow as pa

    new = pa_schema(docs.sparkSession, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    more = [f for f in docs.schema.fields if f.name not in (text, *new.names)]
    at = docs.columns.index(text)
    places = [docs.columns.index(f.name) for f in more]
    kept = docs.select(*(F.col(f"`{key}`").cast("long").alias(key) if c == key else F.col(f"`{c}`") for c in docs.columns))
    ddl = StructType([*StructType.fromDDL(f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary").fields, *more])
    own = docs.columns.index(key)

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            ids = [c.encode(t or "") for t in b.column(at).to_pylist()]
            made = [b.column(own), [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids], ids]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, new)]
            yield pa.RecordBatch.from_arrays([*arrays, *(b.column(i) for i in places)], schema=pa.schema([*new, *(b.schema.field(i) for i in places)]))

    return kept.mapInArrow(run, ddl)
