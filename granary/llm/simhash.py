"""SimHash near-duplicate detection with generalised pigeonhole search.

1. Each text gets a 64-bit fingerprint over its word 3-shingles.
2. Rows with the same fingerprint collapse to one representative, so exact
   copies (however many) never meet as pairs.
3. Bits that are correlated over the corpus are grouped into the same
   partition. Two fingerprints within distance k, split into m partitions with
   thresholds t_1..t_m that sum to k - m + 1, agree within t_i in at least one
   partition i. The thresholds are chosen per fingerprint by dynamic
   programming on estimated candidate counts plus probe costs.
4. Each fingerprint probes every value within its own threshold of its
   partition; an equi-join on (partition, value) finds candidates, and the
   Hamming distance is verified inside the join.
5. Components of the link graph come from alternating large-star and
   small-star steps, each written to the shared folder.

Rows: null texts count as empty; a text without words has fingerprint zero and
is linked like any other. Repeated rows and repeated ids keep one output row
each. A null id keeps its row; it never becomes a component's id unless the
component has no other. An empty table gives an empty result. Only the id and
text columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import ASCII_LOWER, forget, spread_join, staged

BITS = 64
#: Cost of shuffling one probe or index row against that of verifying one candidate.
ROW_COST, CANDIDATE_COST = 1.0, 0.05
#: Shingles whose bits are counted at once, so a very long text needs little memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority vote of the shingles' XXH64 bits; a tie leaves the bit 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(lengths)
    joined, digest, counts = b" ".join(words), xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    starts, stops = (stops - lengths)[:n], stops[min(width, len(words)) - 1 :] - 1
    for low in range(0, n, CHUNK):
        spans = zip(starts[low : low + CHUNK].tolist(), stops[low : low + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        of, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    )


def bit_counts(reps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set. One small matrix per task is summed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(fps), CHUNK):
                bits = np.unpackbits(fps[low : low + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.astype(np.int64).ravel()])], names=["n", "c"])

    parts = reps.select("fp").mapInArrow(of, "n long, c array<long>")
    rows = parts.select("n", F.posexplode("c").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["c"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of almost equal width: each is seeded with a free bit and takes the free bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (sum(corr[b, c] for c in free if c != b), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (sum(corr[b, g] for g in group), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def shells(n: int, p: np.ndarray, group: list[int], values: np.ndarray, most: int) -> np.ndarray:
    """Expected number of fingerprints within distance 0..most of each value of one partition, taking its bits as independent."""
    bits = (values[:, None] >> np.arange(len(group), dtype=np.uint64)) & np.uint64(1)
    agree = np.clip(np.where(bits == 1, p[group], 1 - p[group]), 1e-3, 1 - 1e-3)
    ways = np.zeros((len(values), most + 1))
    ways[:, 0] = 1
    for k in range(len(group)):
        a = agree[:, k : k + 1]
        ways[:, 1:] = ways[:, 1:] * a + ways[:, :-1] * (1 - a)
        ways[:, 0] *= a[:, 0]
    return n * np.cumsum(ways, axis=1)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """costs[q, i, t + 1] is the cost of threshold t (from -1) in partition i; the cheapest thresholds that sum to total, by dynamic programming."""
    q, m, kinds = costs.shape
    low, span = -m, m + total + 1 + m
    best = np.full((q, span + 1), np.inf)
    best[:, -low] = 0
    picks = np.zeros((m, q, span + 1), np.int8)
    for i in range(m):
        step = np.full_like(best, np.inf)
        for t in range(-1, kinds - 1):
            moved = np.full_like(best, np.inf)
            if t < 0:
                moved[:, :-1] = best[:, 1:]
            elif t == 0:
                moved[:] = best
            else:
                moved[:, t:] = best[:, :-t]
            moved += costs[:, i, t + 1 : t + 2]
            better = moved < step
            step[better] = moved[better]
            picks[i][better] = t
        best = step
    at, out = np.full(q, total - low), np.zeros((q, m), np.int64)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][np.arange(q), at]
        at = at - out[:, i]
    return out


def partition_costs(n: int, p: np.ndarray, groups: list[list[int]], values: list[np.ndarray], k: int) -> np.ndarray:
    q, m = len(values[0]), len(groups)
    costs = np.zeros((q, m, k + 2))
    for i, (group, v) in enumerate(zip(groups, values, strict=True)):
        near = shells(n, p, group, v, k)
        for t in range(k + 1):
            costs[:, i, t + 1] = ROW_COST * sum(math.comb(len(group), d) for d in range(t + 1)) + CANDIDATE_COST * near[:, t]
    return costs


def extract(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for at, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
    return out


def choose_groups(n: int, both: np.ndarray, k: int) -> list[list[int]]:
    """The number of partitions whose expected cost per fingerprint is least at this corpus size."""
    p = np.diag(both) / max(n, 1)
    rng, found = np.random.default_rng(7), []
    probe = np.packbits(rng.random((256, BITS)) < p, axis=1, bitorder="little").view(np.uint64).ravel()
    for m in range(2, k + 3):
        groups = correlated_groups(n, both, m)
        costs = partition_costs(n, p, groups, [extract(probe, g) for g in groups], k)
        t = allocate(costs, k - m + 1)
        spent = costs[np.arange(len(probe))[:, None], np.arange(m), t + 1].sum(1).mean()
        found.append((spent + m * ROW_COST, m, groups))
    return min(found)[2]


def links(reps: DataFrame, k: int = 3) -> DataFrame:
    """(a, b) with a < b: every two distinct fingerprints that differ in at most k bits."""
    n, both = bit_counts(reps)
    groups, p = choose_groups(n, both, k), np.diag(both) / max(n, 1)
    m = len(groups)
    masks = [np.array([sum(1 << b for b in flips) for d in range(k + 1) for flips in itertools.combinations(range(len(g)), d)], np.uint64) for g in groups]
    within = [[sum(math.comb(len(g), d) for d in range(t + 1)) for t in range(k + 1)] for g in groups]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i, g in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(extract(fps.view(np.uint64), g).view(np.int64)), pa.array(fps)], names=["part", "value", "b"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                fps = whole.column(0).slice(low, 4096).to_numpy(zero_copy_only=False)
                values = [extract(fps.view(np.uint64), g) for g in groups]
                chosen = allocate(partition_costs(n, p, groups, values, k), k - m + 1)
                for i in range(m):
                    for t in range(k + 1):
                        at = np.flatnonzero(chosen[:, i] == t)
                        if len(at):
                            near = (values[i][at][:, None] ^ masks[i][None, : within[i][t]]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(near), i, np.int32)), pa.array(near.view(np.int64)), pa.array(np.repeat(fps[at], len(near) // len(at)))], names=["part", "value", "a"]
                            )

    fps = reps.select("fp")
    have, ask = fps.mapInArrow(index, "part int, value long, b long"), fps.mapInArrow(probes, "part int, value long, a long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k
    met = ask.hint("merge").join(have, (ask["part"] == have["part"]) & (ask["value"] == have["value"]) & (F.col("a") < F.col("b")) & close)
    return met.select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b): root is its component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014); a node's
    neighbours are only ever aggregated to their minimum, never gathered.
    """
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least_large = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_join(both, least_large, "u", "n").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        after = staged(small.filter("u <> v").distinct(), "edges")
        mark = tuple(after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first())
        forget(edges)
        forget(least_large)
        forget(large)
        edges = after
        if mark == before or mark[0] == 0:
            break
        before = mark
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: id, fp (signed), root (a fingerprint that names the component), component (smallest id reachable over links of at most k differing bits)."""
    prints = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = staged(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "representatives")
    return classified(prints, reps, links(reps, k))


def classified(prints: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """prints (id, fp) with root and component, from the representatives (fp, first, rows: how many have that fp) and the links (a, b) between them."""
    roots = staged(components(pairs), "roots")
    linked = staged(reps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "first", "root"), "linked")
    named = staged(linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("fps")), "named")
    moved = spread_join(linked.select("fp", "root"), named, "root", "fps").select("fp", "root", "component")
    classes = staged(reps.join(moved, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component")), "classes")
    return spread_join(prints, classes, "fp", "rows").select("id", "fp", "root", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id. Of rows of one component that repeat that id, one stays; a component of null ids only keeps one row."""
    return kept(docs, near_duplicates(docs, id_col, text_col, k, width), lambda text: np.uint64(fingerprint(text, width)).view(np.int64), id_col, text_col)


def kept(docs: DataFrame, marks: DataFrame, print_of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay by marks (id, fp, root, component); print_of gives a text's fp."""
    first = staged(marks.filter(F.col("id").eqNullSafe(F.col("component"))).select("id", "fp", "root"), "first")
    counted = first.groupBy("id").agg(F.count("*").alias("__rows")).withColumnRenamed("id", "__id")
    once, often = counted.filter("__rows = 1 and __id is not null"), counted.filter("__rows > 1 or __id is null")
    single = docs.join(once, docs[id_col] == once["__id"], "left_semi")
    several = docs.join(often, docs[id_col].eqNullSafe(often["__id"]), "left_semi")
    return single.unionByName(one_of_each(several, first, id_col, text_col, print_of))


def one_of_each(docs: DataFrame, first: DataFrame, id_col: str, text_col: str, print_of: Callable[[str | None], int]) -> DataFrame:
    """One row of each component, for the few ids that repeat: the one with the least hash over its columns."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(print_of, texts), np.int64, len(texts)))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("__id"), of(F.col(text_col)).alias("__fp"), row.alias("__row"))
    roots = first.select(F.col("id").alias("i"), "fp", "root").distinct()
    met = rows.join(roots, rows["__id"].eqNullSafe(roots["i"]) & (rows["__fp"] == roots["fp"]))
    least = met.groupBy("__id", "root").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return least.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
