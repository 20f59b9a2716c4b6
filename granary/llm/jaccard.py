"""SimHash near-duplicates whose links are verified by exact Jaccard similarity.

1. Each text becomes the set of its word 5-shingles; equal sets collapse to one
   representative. Each has its SimHash fingerprint over the same shingles.
2. What may be alike is proposed twice. The generalised pigeonhole search of
   ``simhash`` finds every two fingerprints that differ in at most k bits. As
   fingerprints of texts with similarity 0.8 mostly differ in more bits than any
   search can afford, BANDS keys of ROWS MinHashes each propose the rest: a pair
   with similarity s shares no key with probability (1 - s ** ROWS) ** BANDS,
   which is 5e-8 at 0.8. What is proposed, directly or through others, makes a
   block.
3. Within a block every pair's similarity is counted exactly from the texts,
   and only pairs with ``similarity`` or more are links. A block of over CELL
   texts of ordinary length is cut into pieces, and each two pieces meet in a
   cell of their own. A cell returns a spanning forest of its links, never the
   pairs.
4. Components of the links come from ``simhash.components``.

Rows: as in ``simhash``; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import simhash
from granary.llm.common import ASCII_LOWER, spread_join, staged

WIDTH, SIMILARITY, BITS = 5, 0.8, 3
BANDS, ROWS = 32, 4
#: Texts of a piece; one with more than LONG shingles counts as several.
CELL, LONG = 1024, 512
#: Shingles whose MinHashes are taken at once.
CHUNK = 1024
#: Of each MinHash, what its values are mixed with; a factor is odd.
FACTORS, FLIPS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = FACTORS * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops])[: max(1, len(words) - width + 1)].tolist()
    ends = (stops[min(width, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def name(held: np.ndarray) -> int:
    """A signed 64-bit number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), 7)).view(np.int64))


def bands(held: np.ndarray) -> list[int]:
    if not len(held):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(held), CHUNK):
        x = (held[None, low : low + CHUNK] ^ FLIPS) * FACTORS
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(1), out=least)
    return [int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), k)).view(np.int64)) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp, sim, size, keys): fp names the set of shingles, sim is the SimHash fingerprint (signed), size the number of shingles, keys are its bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                texts = [t.as_py() for t in part.column(1)]
                held = [shingles(t, width) for t in texts]
                sims = np.fromiter((simhash.fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name(h) for h in held], pa.int64()), pa.array(sims), pa.array([len(h) for h in held], pa.int64()), pa.array([bands(h) for h in held], pa.list_(pa.int64()))], names=["id", "fp", "sim", "size", "keys"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("fp", "sim", "size")], T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(of, kind)


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(member, root) over the links of every two sets that are similar enough, by exact counts."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    held, counts = owner[order], np.bincount(token)
    ends = np.cumsum(counts)
    first = np.concatenate([[0], np.cumsum(sizes)])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        mine = token[first[i] : first[i + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        c = counts[mine]
        at = np.arange(c.sum()) + np.repeat(ends[mine] - c - (np.cumsum(c) - c), c)
        shared = np.bincount(held[at], minlength=n)
        alike = shared * (1 + similarity) >= similarity * (sizes[i] + sizes) - 1e-9
        alike &= shared > 0
        for j in np.flatnonzero(alike[:i]).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def proposed(reps: DataFrame, k: int) -> DataFrame:
    """(a, b): pairs of representatives that join whatever may be alike; of those with one fingerprint or key, each with the least of them."""
    by_print = staged(reps.groupBy("sim").agg(F.min("fp").alias("m"), F.count("*").alias("n")), "fingerprints")
    first, second = (by_print.select(F.col("sim").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    near = simhash.links(by_print.select(F.col("sim").alias("fp")), k).join(first, "a").join(second, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    same = reps.join(by_print.filter("n > 1").select("sim", "m"), "sim").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    keyed = reps.select("fp", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("key", "m")
    banded = keyed.join(least, "key").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return near.union(same).union(banded).filter("a <> b").distinct()


def links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, similarity: float, k: int) -> DataFrame:
    """(a, b): links that join whatever is joined by pairs of representatives (fp, first, sim, size, keys) with this similarity."""
    found = staged(simhash.components(proposed(reps, k)), "near")
    weight = F.ceil(F.greatest("size", F.lit(1)) / LONG).alias("weight")
    blocks = staged(found.join(reps.select(F.col("fp").alias("node"), "first", weight), "node"), "blocks")
    sizes = blocks.groupBy("root").agg(F.ceil(F.sum("weight") / CELL).cast("int").alias("pieces"), F.count("*").alias("n"))
    held = spread_join(blocks, staged(sizes, "sizes"), "root", "n").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    wanted = held.select("node", "first", "root", "piece", other).select("node", "first", "root", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    rows = wanted.join(texts, F.col("first").eqNullSafe(F.col("__id"))).select("root", "i", "j", "node", "t")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if len(cell) > 1:
                names = list(cell)
                if found := forest(list(cell.values()), similarity):
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], names=["a", "b"])

        now, cell = None, {}
        for batch in batches:
            for *key, node, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if key != now:
                    yield from flush()
                    now, cell = key, {}
                if node not in cell:
                    s = shingles(text.as_py(), width)
                    if name(s) == node:  # a repeated id has other texts too
                        cell[node] = s
        yield from flush()

    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(of, "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, k: int = BITS) -> DataFrame:
    """The rows of docs that stay: of each component of similar texts the row with the smallest id, as in ``simhash.keep_first``."""
    marks = staged(prints(docs, id_col, text_col, width), "shingles")
    reps = staged(marks.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("keys").alias("keys")), "representatives")
    found = simhash.classified(marks.select("id", "fp"), reps.select("fp", "first", "rows"), links(docs, reps, id_col, text_col, width, similarity, k))
    return simhash.kept(docs, found, lambda text: name(shingles(text, width)), id_col, text_col)
