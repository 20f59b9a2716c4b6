"""SimHash search against brute force."""

import random

import numpy as np
import pytest
from granary.llm import simhash


def brute(fps: list[int], ids: list[int], k: int = 3) -> dict[int, int]:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, d in enumerate(ids)}


def corpus(n: int = 300) -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)]


def test_fingerprint_by_definition():
    import xxhash

    for text in ("one", "One  two", "a b c d e f a b c", "É É\tÈ x", ""):
        words = "".join(c.lower() if c.isascii() else c for c in text).split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == 0


def test_allocation_is_cheapest():
    import itertools

    costs = np.random.default_rng(1).random((20, 4, 5)) * 10
    costs[:, :, 0] = 0
    for total in (0, -1, 1):
        got = simhash.allocate(costs, total)
        for q in range(20):
            want = min(sum(costs[q, i, t + 1] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, 4), repeat=4) if sum(ts) == total)
            assert got[q].sum() == total
            assert sum(costs[q, i, t + 1] for i, t in enumerate(got[q])) == pytest.approx(want)


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_links_are_complete(spark, monkeypatch, m):
    rng = np.random.default_rng(m)
    centres = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(8):
            x = np.uint64(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            fps.add(int(x.astype(np.int64)))
    monkeypatch.setattr(simhash, "choose_groups", lambda n, both, k: simhash.correlated_groups(n, both, m))
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    flat = sorted(fps)
    want = {(a, b) for i, a in enumerate(flat) for b in flat[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_near_duplicates(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, " \n"), (903, "w1 " * 30000), (904, "w1 " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = [simhash.fingerprint(t) for _, t in rows]
    want = brute(fps, [d for d, _ in rows])
    assert got == {d: (fp, want[d]) for fp, (d, _) in zip(fps, rows, strict=True)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "quite other words here"), (2, "a b c d"), (None, "x y z"), (None, "x y z"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == [(-1, "x y z"), (1, "a b c d"), (1, "quite other words here")]
    assert simhash.keep_first(docs.limit(0)).count() == 0
