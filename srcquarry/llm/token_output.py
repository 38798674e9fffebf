"""Token-ID / binary output (operator 1): frequency-ranked ids in a byte-aligned variable-length code.

Coding.  Ids are replaced by their rank in the whole corpus (most frequent first, ties by id), so that frequent ids are
small numbers.  A number takes one to four bytes, least significant first.  The lengths stand apart from the numbers: a
control byte holds four of them, two bits each.  Decoding looks up each control byte in a table of 256 rows for the four
lengths, and numpy gathers the numbers; no branch depends on the data.

Files.  Documents are dealt by ranges of doc_id and sorted, so the table's parts hold all documents in ascending order.
Each row of the Parquet table is a block of about 64 Ki ids: part, start within the part, doc ids, their lengths, control
bytes, data bytes.  The rank table is bounded by the vocabulary and travels to the tasks.

Cases: a null or empty text has only the end id; rows that repeat a doc_id follow each other, ordered by their ids; an
empty table gives an empty table; a null doc_id comes first.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.bpe import byte_alphabet
from srcquarry.llm.common import Memo, chunks, held, keyed_text, map_rows, pa_schema, scratch, stored

BLOCK_IDS = 1 << 16
BLOCK = "part int, start long, docs array<long>, lengths array<long>, control binary, data binary"
#: Row c: the four lengths that control byte c holds.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

#: The normaliser and pre-tokenizer that ``WordEncoder`` may stand in for; of any other file the library encodes whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    four = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    four[: len(v)] = extra
    return (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        out[some] |= raw[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Classes of the first 256 code points, and their lower case with white space made alike.
OTHER, SPACE, LETTER, DIGIT = range(4)
CLASSES = np.array([SPACE if c in "\t\n\v\f\r \x85\xa0" else LETTER if c.isalpha() else DIGIT if c in "0123456789²³¹¼½¾" else OTHER for c in map(chr, range(256))], np.uint8)
LOWER = bytes(32 if CLASSES[c] == SPACE else ord(chr(c).lower()) for c in range(256))
ENDINGS = np.array([c in b"stmd" for c in range(256)])
TWO_LETTERS = [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]


def piece_starts(letters: np.ndarray) -> np.ndarray:
    """Where the pretokens of lower-cased Latin-1 text start: runs of letters and of other signs, single digits, and the endings
    's 't 're 've 'm 'll 'd, unless other signs stand right before them."""
    kind = CLASSES[letters]
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == DIGIT
    start &= kind != SPACE
    at = np.flatnonzero((letters == 0x27) & start)
    after = np.concatenate([letters, np.full(3, 32, np.uint8)])
    one = ENDINGS[after[at + 1]]
    two = ~one & np.isin(after[at + 1].astype(np.int32) << 8 | after[at + 2], TWO_LETTERS)
    start[at[one | two] + 1] = False
    for ends in (at[one] + 2, at[two] + 3):
        start[ends[CLASSES[after[ends]] == LETTER]] = True
    return np.flatnonzero(start)


class WordEncoder:
    """The tokenizers library, asked once for each distinct pretoken of ordinary text and for odd texts as a whole.

    The pretokens of many texts are found by numpy and made distinct by Arrow, so that Python meets each once for
    half a million characters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        flags = {x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")}
        self.simple = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and flags <= {False}
        self.of = {b: c for c, b in byte_alphabet().items()}
        self.tokenize = self.library.model.tokenize
        self.piece = Memo(self._piece, 400_000)

    def _piece(self, piece: bytes) -> bytes:
        letters = piece.decode("latin-1")
        if not piece.isalpha() and not (piece.isascii() and letters.isprintable()):  # printable ASCII stands for itself
            letters = "".join(map(self.of.__getitem__, letters.encode()))
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def ordinary(self, text: str) -> bytes | None:
        """The lower case of text below code point 256, which is in NFC and whose lower case does not depend on the neighbours."""
        if not self.simple or any(s in text for s in self.special):
            return None
        try:
            return text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for some in chunks(texts, 1 << 19) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.ordinary(t) for t in texts]
        text = b" ".join(p for p in plain if p is not None)
        starts = piece_starts(np.frombuffer(text, np.uint8))
        ends = np.cumsum([0] + [len(p) + 1 for p in plain if p is not None])
        # each piece reaches to the next one, white space included
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(text)).astype(np.int32)), pa.py_buffer(text)]).dictionary_encode()
        which = np.frombuffer(pieces.indices.buffers()[1], np.int32, len(starts))  # to_numpy would load pandas, to_pylist is slow
        _, at, distinct = pieces.dictionary.buffers()
        at, distinct = np.frombuffer(at, np.int32, len(pieces.dictionary) + 1).tolist(), distinct.to_pybytes()
        known = [self.piece[distinct[a:b].rstrip(b" ")] for a, b in zip(at, at[1:])]
        pool, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = iter(upto[np.searchsorted(starts, ends)].tolist())
        out, a = [], next(cuts)
        for t, p in zip(texts, plain):
            if p is None:
                out.append(array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                a, b = next(cuts), a
                out.append(ids[b:a].tobytes())
        return out


def word_encoder(path: str) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    return held(("words", path), lambda: WordEncoder(path))


def tokenised(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, ids): 16-bit ids where the vocabulary allows, else 32-bit."""

    def start():
        e = word_encoder(path)
        kind, end = "<u2" if e.size <= 1 << 16 else "<u4", end_id.to_bytes(4, "little")
        return lambda keys, texts: {key: keys, "ids": [np.frombuffer(ids + end, "<u4").astype(kind).tobytes() for ids in e.encode_all(texts)]}

    return map_rows(keyed_text(docs, key, text), f"{key} long, ids binary", start, key, text)


def frequencies(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id stands in the whole corpus; one row for each id and task is shuffled."""
    out = pa_schema(ids.sparkSession, "id int, n long")

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=out)

    total = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    return total


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Write the token file to folder ``out``; returns the id of each rank, which its readers need."""
    spark, size = docs.sparkSession, word_encoder(path).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    ids = stored(tokenised(docs, path, end_id, key, text), "ids")
    n = frequencies(ids, size, kind)
    order = np.lexsort((np.arange(size), -n)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    schema = pa_schema(spark, BLOCK)

    def blocks(batches):
        part, at = TaskContext.get().partitionId(), 0
        keys, rows, held = [], [], 0

        def block():
            flat = np.frombuffer(b"".join(rows), kind)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, at, keys, [len(r) // int(kind[2]) for r in rows], *pack(rank[flat])), schema)], schema=schema), len(flat)

        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                rows.append(r)
                held += len(r) // int(kind[2])
                if held >= BLOCK_IDS:
                    made, more = block()
                    yield made
                    keys, rows, held, at = [], [], 0, at + more
        if rows:
            yield block()[0]

    ids.repartitionByRange(F.col(key)).sortWithinPartitions(key, "ids").mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(out)
    return order


def read(spark, path: str, order: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, start, ids binary): each document's ids, and how many ids all documents before it have."""
    rows = spark.read.schema(BLOCK).parquet(path)
    totals = {r.part: r.n for r in rows.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    ddl = f"{key} long, start long, ids binary"
    out = pa_schema(spark, ddl)

    def decode(batches):
        for b in batches:
            for r in range(b.num_rows):
                part, start, docs, sizes, control, data = (c[r].as_py() for c in b.columns)
                ends = np.cumsum(np.array(sizes, np.int64))
                ids = order[unpack(control, data, int(ends[-1]))]
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + (base[part] + start)), pa.array([ids[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary())], schema=out)

    return rows.mapInArrow(decode, ddl)


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of what ``read`` gives."""
    ddl = f"{key} long, start long, n_tokens long, ids_crc32 long"
    out = pa_schema(tokens.sparkSession, ddl)

    def run(batches):
        for b in batches:
            ids = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())], schema=out)

    return tokens.select(key, "start", "ids").mapInArrow(run, ddl)


def round_trip(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = scratch(docs.sparkSession, "tokens")
    return digests(read(docs.sparkSession, out, write(docs, path, out, end_id, key, text), key), key)
