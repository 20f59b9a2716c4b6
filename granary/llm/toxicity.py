"""Toxicity by compression distance.

zstandard trains separate dictionaries on windows of ordinary and of toxic text
(``zstandard.train_dictionary``), from a bounded sample of labelled rows. A
window is WORDS consecutive words with the blanks around them; a text's windows
start at each of its words.
A window's gain is the bytes by which the toxic dictionary compresses it below
the ordinary one. The trainer gets each document's windows as one sample, so it
prefers what many documents hold. Documents are marked as wholes, so most
windows of a toxic one are ordinary: training is repeated, the toxic dictionary
on those windows of each toxic text with the highest gains so far and with less
room each time, the ordinary one on ordinary texts and again on those of their
windows with too high a gain.

The sample is dealt to PARTS parts; each pair of dictionaries is trained on all
parts but one, and a window counts with its smallest gain: what only one part
happens to hold doesn't count, and no text is calibrated by dictionaries alone
that hold it. The map from the numbers of windows over several thresholds to a
probability is calibrated on the sample.

A constant tail follows each window, because zstandard searches no match in the
last bytes of its input; all dictionaries end with it.

Rows: null texts count as empty; a text without words scores like one without
windows over a threshold. Every row gets a row, repeated ones too. Without
labelled rows of both classes, or with too few documents for zstandard to train
on, every score is the share of label 1 (0 without any). An empty table gives
an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import ASCII_LOWER
from granary.llm.labelled import fold, logistic, sample

#: Words of a window. Longer windows drown short insults: with 2, an earlier training found fewer toxic texts (figures in the README).
WORDS = 1
#: Bounds of the labelled sample: rows, and words that stand for a text (a longer one by BLOCK-word runs spread evenly over it).
ROWS, SPREAD, BLOCK = 5000, 2000, 50
#: Parts of the sample, each left out by one pair of dictionaries.
PARTS = 3
#: Size of the ordinary dictionaries.
ORDINARY_BYTES = 110_000
#: Of each round, the share of a toxic text's windows that the next one takes and the toxic dictionary's size; how often an ordinary window counts again whose gain is at least HARD.
SCHEDULE, WEIGHT, HARD = ((0.1, 32_768), (0.05, 16_384), (0.05, 8192), (0.05, 4096)), 8, 2
#: What the trainer counts, in bytes: grams, short enough to lie within a word, and the segments of text that it chooses by them.
GRAM, SEGMENT = 6, 32
#: Fewer windows aren't trained on.
LEAST = 100
THRESHOLDS = (2, 3, 4, 5, 6, 8)
TAIL = b" the window ends here"
EDGES = b".,;:!?\"'()"
#: Windows whose gains a worker remembers.
REMEMBERED = 200_000


def words(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(EDGES) for x in (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()) if w]


def spread(found: list[bytes], limit: int = SPREAD) -> list[bytes]:
    """All words, or runs of BLOCK words that lie evenly over them."""
    if len(found) <= limit:
        return found
    starts = np.linspace(0, len(found) - BLOCK, limit // BLOCK).astype(int).tolist()
    return [w for at in starts for w in found[at : at + BLOCK]]


def windows(found: list[bytes]) -> list[bytes]:
    if len(found) <= WORDS:
        return [b" " + b" ".join(found) + b" "] if found else []
    return [b" " + b" ".join(found[i : i + WORDS]) + b" " for i in range(len(found) - WORDS + 1)]


def trained(texts: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer chooses from the windows, with the tail; its entropy tables are left out, as they cost more than they save on windows so short."""
    held = zstandard.train_dictionary(size, texts, k=SEGMENT, d=GRAM).as_bytes()
    return held[-(size - 512) :] + TAIL


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plan = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, window_log=17, hash_log=14, chain_log=14, search_log=7, target_length=64, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=plan)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=plan)


class Pair:
    """An ordinary and a toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def gain(self, window: bytes) -> int:
        whole = window + TAIL
        return len(self.ordinary(whole)) - len(self.toxic(whole))

    def gains(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Of each document's windows; equal windows are compressed once."""
        of = {w: self.gain(w) for w in {w for d in docs for w in d}}
        return [np.fromiter(map(of.__getitem__, d), np.int64, len(d)) for d in docs]


class Gains:
    """The smaller gain of a window over all pairs; once one is below the least that matters, the others aren't asked."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs, self.least, self.known = [Pair(*p) for p in pairs], min(THRESHOLDS), {}

    def of(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            for pair in self.pairs:
                g = pair.gain(window)
                found = g if found is None else min(found, g)
                if found < self.least:
                    break
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[window] = found
        return found


@dataclass
class Model:
    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    fit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    flat: float | None = None

    def gains(self) -> Gains | None:
        return None if self.flat is not None else Gains(self.pairs)

    def scores(self, texts: Iterator[str | None], gains: Gains | None) -> np.ndarray:
        if gains is None:
            return np.array([self.flat for _ in texts], float)
        x = np.array([features(map(gains.of, windows(words(t)))) for t in texts], float).reshape(-1, 2 * len(THRESHOLDS))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.fit, -30, 30)))


def features(gains: Iterator[int]) -> list[float]:
    """Of the windows with at least each threshold's gain: how many, and how many of a thousand."""
    g = np.fromiter(gains, np.int64)
    over = np.count_nonzero(g[None, :] >= np.array(THRESHOLDS)[:, None], axis=1)
    return [*np.log1p(over), *np.log1p(1000 * over / max(1, len(g)))]


def pair_of(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes] | None:
    """Dictionaries trained in rounds on the windows of ordinary and of toxic texts, each text's as one sample; None where there are too few."""
    held, marked, again = None, toxic, []
    plain = [b"".join(d) for d in ordinary]
    for k, (share, size) in enumerate(SCHEDULE):
        if min(sum(map(len, ordinary)), sum(map(len, marked))) < LEAST:
            break
        try:
            held = trained(plain + again, ORDINARY_BYTES), trained([b"".join(d) for d in marked], size)
        except zstandard.ZstdError:  # too little text for dictionaries of these sizes
            break
        if k + 1 < len(SCHEDULE):
            pair = Pair(*held)
            marked = [highest(d, g, share) for d, g in zip(toxic, pair.gains(toxic), strict=True)]
            hard = (b"".join(w for w, n in zip(d, g, strict=True) if n >= HARD) for d, g in zip(ordinary, pair.gains(ordinary), strict=True))
            again = WEIGHT * [t for t in hard if t]
    return held


def highest(found: list[bytes], gains: np.ndarray, share: float) -> list[bytes]:
    """The share of a text's windows, at least one, with the highest gains, in order."""
    return [found[i] for i in sorted(np.argsort(-gains, kind="stable")[: math.ceil(share * len(found))].tolist())]


def pair_without(left: int, texts: list[str], y: np.ndarray) -> tuple[bytes, bytes] | None:
    """The pair trained on all parts but one; equal texts lie in one part."""
    rank, known = {t: k for k, t in enumerate(dict.fromkeys(texts))}, {}
    by: tuple[list[list[bytes]], list[list[bytes]]] = ([], [])
    for t, label in zip(texts, y, strict=True):
        if rank[t] % PARTS != left and (found := windows(spread(words(t)))):
            by[int(label)].append([known.setdefault(w, w) for w in found])
    return pair_of(*by)


def fit(texts: list[str], y: np.ndarray, each: Callable = map) -> Model:
    """each(f, parts) gives f of each part; train has the executors do that."""
    if not len(y) or y.min() == y.max():
        return Model(flat=float(y.mean()) if len(y) else 0.0)
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode("utf-8", "surrogatepass")), texts[i], y[i]))
    texts, y = [texts[i] for i in order], y[order]
    pairs = [p for p in each(partial(pair_without, texts=texts, y=y), range(PARTS)) if p is not None]
    if not pairs:
        return Model(flat=float(y.mean()))
    gains = Gains(pairs)
    return Model(pairs, logistic(np.array([features(map(gains.of, windows(spread(words(t))))) for t in texts]), y, ridge=1.0))


def on_executors(spark: SparkSession) -> Callable:
    """each() of fit, a task for each part; what comes back is a few dictionaries."""

    def each(f: Callable, parts: range) -> list[tuple[bytes, bytes] | None]:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [f(k) or (None, None) for k in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([h[i] for h in held], pa.binary()) for i in (0, 1))], names=["id", "ordinary", "toxic"])

        rows = spark.range(0, len(parts), 1, len(parts)).mapInArrow(of, "id long, ordinary binary, toxic binary").collect()
        return [None if r.ordinary is None else (bytes(r.ordinary), bytes(r.toxic)) for r in sorted(rows, key=lambda r: r.id)]

    return each


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = ROWS) -> Model:
    """Fit from at most `rows` labelled rows outside the held-out fold, each by at most SPREAD of its words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [b" ".join(spread(words(t.as_py()))).decode("utf-8", "surrogatepass") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), b.column(1)], names=["text", "label"])

    picked = sample(docs, labels, label, folds, held_out, rows).mapInArrow(of, "text string, label int").collect()
    picked.sort(key=lambda r: (r["text"], r["label"]))
    return fit([r["text"] for r in picked], np.array([r["label"] for r in picked], float), on_executors(docs.sparkSession))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores((t.as_py() for t in b.column(1)), gains))], names=["id", "score"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, kind)
    out = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False))
    return scored.select("id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
