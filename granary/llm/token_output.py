"""Token-ID output in checksummed, compressed segments.

Texts are encoded with the tokenizers library, an end id follows each document,
and documents go to disk in ascending id order. A file row is one segment: whole
documents of about SEGMENT ids, as a header, a document index and blocks of the
range coder in token_codec, each reset and checksummed by itself. Segments are
written by Spark's own writer, so a lost executor's segments are written anew
and any storage that Spark reaches will do.

Segment payload, little-endian: magic, number of documents, number of blocks;
per document its id (int64), whether it has one (uint8) and its number of ids
(uint64); per block its length (uint32); the blocks; CRC-32 of all before.

Encoding remembers the ids of words: pre-tokens are encoded one by one in this
kind of vocabulary, so each distinct one needs the library's model only once. A
text with any character outside PLAIN, or that may hold a special token, is
encoded whole by the library.

Rows: null texts count as empty and have the end id alone. Rows that repeat an
id are ordered by text; null ids come first. An empty table gives no segments.
Ids must be whole numbers; other columns don't matter.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import token_codec

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC, HEAD = b"GTS1", struct.Struct("<4sII")
SEGMENT = token_codec.BLOCK
REMEMBERED = 800_000
#: Bytes of text that are encoded at a time: the more, the fewer distinct words to look up.
SLICE = 4 << 20
#: Characters for which splitting and lower-casing here and in the library agree: printable ASCII, tab, line breaks and Latin-1 letters.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The vocabulary's pre-tokenizer, as its file states it (a fixed value), and what it comes to after lower-casing PLAIN text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")

#: Latin-1 bytes of PLAIN, lower-cased text: ! for each character that is neither a letter, a digit nor white space.
SYMBOLS = bytes(32 if b in b" \t\n\r" else 97 if chr(b).isalpha() or chr(b).isdigit() else 33 for b in range(256))


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does, remembering pre-tokens."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.size, self.end = max(self.whole.get_vocab_size(), end + 1), end
        self.model, self.letters = self.whole.model, byte_letters()
        self.special = [t["content"] for t in plan.get("added_tokens", [])]
        split = [s.get("pattern", {}).get("Regex") for s in (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [s["type"] for s in (plan.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = split == [SPLIT, None] and kinds == ["NFC", "Replace", "Lowercase"]
        self.clear()

    def clear(self) -> None:
        """Forget everything. Words between white space and pre-tokens share one table: each has a place in the pool of ids."""
        pool, start, length = self.pool, self.start, self.length = array("i"), array("i"), array("i")
        tokenize, letter = self.model.tokenize, self.letters.__getitem__

        class Known(dict):
            def __missing__(self, word: str) -> int:
                if word.isalpha() or len(pieces := PIECES.findall(word)) == 1:  # PLAIN's lower-cased letters are one pre-token
                    ids = [t.id for t in tokenize(word if word.isascii() else "".join(map(letter, word.encode())))]
                else:
                    ids = []
                    for at in map(self.__getitem__, pieces):
                        ids += pool[start[at] : start[at] + length[at]]
                return self.take(word, ids)

            def take(self, word: str, ids: list[int]) -> int:
                self[word] = at = len(start)
                start.append(len(pool))
                length.append(len(ids))
                pool.extend(ids)
                return at

        self.known = Known()
        self.known.take("", [self.end])

    def plain(self, text: str) -> bool:
        return self.by_piece and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        plain = [self.plain(text) for text in texts]
        known, counts = self.of_plain([t for t, p in zip(texts, plain, strict=True) if p])
        if all(plain):
            return known, counts
        ends, out = iter(np.cumsum(counts).tolist()), []
        counts = iter(counts.tolist())
        for text, p in zip(texts, plain, strict=True):
            if p:
                stop = next(ends)
                out.append(known[stop - next(counts) : stop])
            else:
                out.append(np.array([*self.whole.encode(text, add_special_tokens=False).ids, self.end], np.int32))
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)

    def of_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain texts. Arrow splits them and finds the distinct words, so that only these are looked up one by one."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.known) > REMEMBERED:
            self.clear()
        ready = []
        for text in texts:
            text = text.lower()
            if b"!!" not in text.encode("latin-1").translate(SYMBOLS):  # then a comma or full stop is a pre-token by itself wherever it stands
                text = text.replace(",", " , ").replace(".", " . ")
            text = text.strip()
            ready.append(text and text + " ")  # splits to its words and an empty one, which stands for the end id
        split = pc.ascii_split_whitespace(pa.array(ready, pa.large_string()))
        words = split.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
        pool, start, lengths = (np.frombuffer(x, x.typecode) for x in (self.pool, self.start, self.length))
        word = words.indices.to_numpy()
        length = lengths[at][word]
        ends = np.cumsum(length, dtype=np.int32)
        ids = pool[np.repeat(start[at][word] - ends + length, length) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.add.reduceat(length, split.offsets.to_numpy()[:-1], dtype=np.int64)


ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One encoder per worker process, kept over its tasks."""
    if (path, end) not in ENCODERS:
        ENCODERS[path, end] = Encoder(path, end)
    return ENCODERS[path, end]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of its second column each, whole rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), batch.num_rows]
    for low, high in itertools.pairwise(cuts):
        yield batch.slice(low, high - low)


def pack(doc_ids: list, counts: list[int], ids: np.ndarray, alphabet: int) -> bytes:
    blocks = [token_codec.encode(ids[k : k + token_codec.BLOCK], alphabet) for k in range(0, len(ids), token_codec.BLOCK)]
    parts = [
        HEAD.pack(MAGIC, len(doc_ids), len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        np.array(counts, "<u8").tobytes(),
        np.array(list(map(len, blocks)), "<u4").tobytes(),
        *blocks,
    ]
    front = b"".join(parts)
    return front + struct.pack("<I", zlib.crc32(front))


def unpack(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids; ValueError for a damaged segment."""
    if len(payload) < HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged segment")
    magic, docs, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = HEAD.size
    doc_ids, at = np.frombuffer(payload, "<i8", docs, at), at + 8 * docs
    there, at = np.frombuffer(payload, "u1", docs, at), at + docs
    counts, at = np.frombuffer(payload, "<u8", docs, at).astype(np.int64), at + 8 * docs
    sizes, at = np.frombuffer(payload, "<u4", n, at), at + 4 * n
    out = []
    for size in sizes.tolist():
        out.append(token_codec.decode(payload[at : at + size]))
        at += size
    return [d if h else None for d, h in zip(doc_ids.tolist(), there.tolist(), strict=True)], counts, np.concatenate(out) if out else np.zeros(0, np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, as_stored: bool = False) -> None:
    """Write docs' segments as Parquet rows (part, seg, before, n_docs, n_tokens, payload) at path; (part, seg) is the order of the segments, before counts the ids of the part's earlier ones. Documents come in ascending order of their id or, with as_stored, in the order of the rows in docs' files (of its partitions, where docs isn't read from files)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg, before = encoder(tokenizer, end), TaskContext.get().partitionId(), 0, 0
        held_ids, held_counts, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"part": part, "seg": seg, "before": before, "n_docs": len(held_ids), "n_tokens": len(ids), "payload": pack(held_ids, held_counts, ids, enc.size)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for some in slices(batch):
                ids, counts = enc.encode([t or "" for t in some.column(1).to_pylist()])
                ends = np.cumsum(counts)
                for doc, count, stop in zip(some.column(0).to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                    held_ids.append(doc)
                    held_counts.append(count)
                    held.append(ids[stop - count : stop])
                    size += count
                    if size >= segment:
                        yield out()
                        seg, before = seg + 1, before + size
                        held_ids, held_counts, held, size = [], [], [], 0
        if held_ids:
            yield out()

    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if as_stored:
        try:
            rows = docs.select(*[F.col(c).alias(a) for c, a in ((id_col, "id"), (text_col, "text"))], F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
            place = [F.length("file"), F.col("file"), F.col("row")]  # longer names belong to later partitions
        except AnalysisException:
            rows, place = rows.withColumn("row", F.monotonically_increasing_id()), [F.col("row")]
        ordered = rows.withColumn("id", F.col("id").cast("bigint")).repartitionByRange(n, *place).sortWithinPartitions(*place).select("id", "text")
    else:
        ordered = rows.repartitionByRange(n, F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"), "text")
    ordered.mapInArrow(of, "part int, seg int, before long, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document, read back from the segments: doc (id), start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    files = spark.read.parquet(path)
    totals = sorted((r["part"], r["t"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("t")).collect())  # a row per partition
    offsets, total = [], 0
    for part, t in totals:
        offsets.append((part, total))
        total += t
    base = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, counts, ids = unpack(batch.column(1)[row].as_py())
                ends, raw = np.cumsum(counts), ids.astype("<u4")
                crcs = [zlib.crc32(raw[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - counts + batch.column(0)[row].as_py()), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc", "start", "n_tokens", "ids_crc32"])

    placed = files.join(base, "part").select((F.col("base") + F.col("before")).alias("base"), "payload")
    return placed.mapInArrow(of, "doc long, start long, n_tokens long, ids_crc32 long")
