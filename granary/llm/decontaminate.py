"""Benchmark decontamination by spaced-seed hashing.

Words of documents and benchmark items are hashed. A spaced seed is a fixed
mask of kept positions; at every word of a document, and of an item, the kept
words under each mask are hashed together, so substitutions at ignored
positions don't matter. Equal hashes propose an alignment of an item with a
place in a document, and the alignment is verified word by word around the hit.
Of consecutive hits on one alignment only the first is verified, so a copy of
any length, or a text of one repeated word, costs one verification an alignment.

A document leaks an item if WINDOW consecutive words of the item stand against
WINDOW consecutive words of the document with at least ``similarity`` of them
equal. The default masks hit every such window (``covers`` proves it), so
nothing is missed. Items of MIN_WORDS to WINDOW - 1 words must stand whole, with
at least ``short`` of their words equal: cut into one piece more than words may
differ, some piece stands unchanged. Shorter items can't be told from ordinary
text inside one; with ``short`` below 1 they match where they are the whole
document, and with 1 nothing.

Only the benchmark is broadcast, in blocks of about BLOCK_WORDS words; the
documents are never shuffled before verification. Words are runs of letters,
digits and non-ASCII characters, with A-Z lower-cased.

Rows: null texts and items count as empty. Repeated documents or items give the
rows of one: results are per (id, text) and item. An empty table gives an empty
result. Only id and text columns are read, so other columns don't matter.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.licenses import words

WINDOW, SIMILARITY, MIN_WORDS, BLOCK_WORDS = 13, 0.8, 5, 200_000

#: Kept positions of each spaced seed.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))


def covers(masks: tuple[tuple[int, ...], ...], window: int, differing: int) -> bool:
    """Whether any window with so many differing words is hit by some mask at some place."""
    places = [{s + o for o in m} for m in masks for s in range(window - m[-1])]
    return all(any(not p & set(bad) for p in places) for bad in itertools.combinations(range(window), differing))


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed(k: int, mask: tuple[int, ...], i: Column) -> Column:
    """Hash of the words under the mask at word i; null where it would reach past the end."""
    return F.when(i + mask[-1] < F.col("n"), F.xxhash64(F.lit(k), *[F.get("h", i + o) for o in mask]))


def seeded(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row (…, i, k, key) for each word and mask k."""
    at = rows.select("*", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("i"))  # a filter would be pushed below the hashing and repeat it
    return at.select("*", F.posexplode(F.array(*[seed(k, m, F.col("i")) for k, m in enumerate(masks)])).alias("k", "key")).filter("key is not null")


def before(masks: list[tuple[int, ...]]) -> Column:
    """The key of the same mask one word earlier; null at the first word."""
    found = F.lit(None).cast("bigint")
    for k, m in enumerate(masks):
        found = F.when(F.col("k") == k, seed(k, m, F.col("i") - 1)).otherwise(found)
    return F.when(F.col("i") > 0, found)


def best_window(same: Column, window: int) -> Column:
    """Most equal words in any `window` consecutive positions of an array of 0 and 1; it has at least that many."""

    def step(s: Column, k: Column) -> Column:
        now = s["now"] + F.get(same, k) - F.when(k >= window, F.get(same, k - window)).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(F.sequence(F.lit(0), F.size(same) - 1), zero, step, lambda s: s["top"])


def once(x: Column) -> Column:
    """x as the only element of an exploded array: later filters stay above it, so x is evaluated once."""
    return F.explode(F.array(x))


def pieces(n: int, differing: int) -> list[tuple[int, int]]:
    """(start, length) of differing + 1 pieces of n words: with so many words changed, one piece isn't."""
    cuts = [n * k // (differing + 1) for k in range(differing + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, masks: tuple[tuple[int, ...], ...] = MASKS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", short: float = 1.0,
) -> DataFrame:
    """(id, tag, item, item_words, overlap, matched): a row for each leaking document (id, tag: hash of its text) and item. overlap: equal words of the best window; matched: of the best alignment."""
    need = math.ceil(similarity * window - 1e-9)
    if not covers(masks, window, window - need):
        raise ValueError("the masks don't hit every window that is similar enough")
    items = benchmark.select(F.col(item_col).alias("item"), hashes(F.col(item_text)).alias("h")).withColumn("n", F.size("h")).filter(F.col("n") >= (MIN_WORDS if short >= 1 else 1)).distinct()
    items = items.withColumn("ik", F.xxhash64("item", "h"))
    sizes = items.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()
    blocks = max(1, math.ceil(sum(r["n"] * r["c"] for r in sizes) / BLOCK_WORDS))
    least = {r["n"]: math.ceil(short * r["n"] - 1e-9) if r["n"] >= MIN_WORDS else r["n"] for r in sizes if r["n"] < window}
    cut = {n: pieces(n, n - equal) for n, equal in least.items()}
    whole = {length: len(masks) + k for k, length in enumerate(sorted({length for held in cut.values() for _, length in held}))}
    every = [*masks, *(tuple(range(length)) for length in whole)]
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tag"), hashes(F.col(text_col)).alias("h")).withColumn("n", F.size("h"))
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod("ik", F.lit(blocks)) == block)
        long = seeded(part.filter(F.col("n") >= window), list(masks)).select("key", "ik", F.col("i").alias("j"), before(list(masks)).alias("prior"))
        short = [
            part.filter(F.col("n") == n).filter(F.size("h") == n).select(seed(whole[length], every[whole[length]], F.lit(at)).alias("key"), "ik", F.lit(at).alias("j"), F.lit(None).cast("bigint").alias("prior"))
            for n, held in cut.items() for at, length in held
        ]
        index = long
        for s in short:
            index = index.union(s)
        about = part.select("ik", "item", F.col("h").alias("g"), F.col("n").alias("m"))
        hits = seeded(read, every).join(F.broadcast(index), "key")
        hits = hits.filter(~F.coalesce(F.col("prior") == before(list(masks)), F.lit(False))).join(F.broadcast(about), "ik")
        first = F.greatest(F.col("j") - F.col("i"), F.lit(0))  # of the item's words, the first that has a word of the document beside it
        length = F.least("m", F.col("n") - F.col("i") + F.col("j")) - first
        ours = F.slice("h", F.greatest(F.col("i") - F.col("j"), F.lit(0)) + 1, length)
        tiny = (F.col("m") >= MIN_WORDS) | (F.col("m") == F.col("n"))
        aligned = hits.filter(tiny & (length >= F.least(F.lit(window), F.col("m")))).select("id", "tag", "ik", "item", "m", ours.alias("a"), F.slice("g", first + 1, length).alias("b"))
        equal = F.zip_with("a", "b", lambda x, y: (x == y).cast("int"))
        same = aligned.select("id", "tag", "ik", "item", "m", once(equal).alias("same"))
        total = F.aggregate("same", F.lit(0), lambda s, x: s + x)
        overlap = F.when(F.col("m") >= window, best_window(F.col("same"), window)).otherwise(total)
        scored = same.select("id", "tag", "ik", "item", "m", once(F.struct(total.alias("matched"), overlap.alias("overlap"))).alias("found")).select("id", "tag", "ik", "item", "m", "found.*")
        enough = F.lit(need)
        for n, equal in least.items():
            enough = F.when(F.col("m") == n, equal).otherwise(enough)
        close = scored.filter(F.col("overlap") >= enough)
        rows = close.groupBy("id", "tag", "ik").agg(F.first("item").alias("item"), F.first("m").alias("item_words"), F.max("overlap").alias("overlap"), F.max("matched").alias("matched"))
        found = rows if found is None else found.union(rows)
    return found.select("id", "tag", "item", "item_words", "overlap", "matched")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: float = 1.0) -> DataFrame:
    """The rows of docs that leak no item, all columns as they were."""
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, short=short).select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    met = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["__tag"])
    return docs.join(bad, met, "left_anti")
