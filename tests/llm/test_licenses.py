"""Licence scan against brute force."""

import random
import re

import pytest
from granary.llm import licenses as L


def brute(text, templates, df, coverage=0.75):
    w = [x for x in re.split(L.BETWEEN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    places, base, own = [], set(), set()
    for t in templates:
        n, at = len(t.words), L.anchor(t, df)
        for s in range(-n, len(w)):
            if not 0 <= s + at < len(w) or w[s + at] != t.words[at]:
                continue
            same = sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t.words))
            if t.base and same == n:
                places.append(s)
                base.add(t.label)
            if not t.base and same >= coverage * n and f" {' '.join(t.key.split())} " in " " + " ".join(w[max(s, 0) : s + n]) + " ":
                own.add(t.label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.8 if base else 0.0


def test_scan_by_brute_force(spark):
    rng = random.Random(2)
    pool = sorted({w for t in L.BASE + L.NOTICES for w in t.words}) + ["É", "x9", "foo"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for t in L.BASE + L.NOTICES:
        cut = t.text.split()
        for k in range(3):
            texts.append("Some words. " * k + " ".join(w if rng.random() > 0.08 * k else "zz" for w in cut) + ", MIT-License\n" * (k == 2))
    texts += [None, "", "...", "mit license", "MIT LICENSE mit license", "license mit", "word " * 50000 + "mit license", "version 2 0 apache"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as w", "2 as rare", "3 as n_words")
    templates = L.BASE + L.NOTICES
    df = L.rarity(docs, templates)
    lowered = [set(x for x in re.split(L.BETWEEN, (t or "").lower()) if x) for t in texts]
    assert df == {k: sum(k in x for x in lowered) for k in df}
    got = {r.id: tuple(r)[1:] for r in L.scan(docs, templates, df).collect()}
    assert got == {i: brute(t, templates, df) for i, t in enumerate(texts)}


def test_repeats_nulls_empty_and_bounds(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, None)], "doc_id long, text string")
    rows = L.scan(docs).collect()
    assert sorted((r.id or -1, r.base_labels, r.score) for r in rows) == [(-1, "", 0.0), (1, "mit", 0.8), (1, "mit", 0.8)]
    assert L.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.scan(docs, L.BASE * 100)


def test_notices_without_their_rarest_word(spark):
    rng = random.Random(8)
    texts = ["Code is subject to the terms of the Mozilla Public License, version 2.0 here.", "mit license"]
    for t in L.NOTICES:
        for _ in range(12):
            texts.append("x " * rng.randint(0, 3) + " ".join(w if rng.random() > 0.2 else "zz" for w in t.words) + " y" * rng.randint(0, 3))
    want = []
    for text in texts:
        w, own = [x for x in re.split(L.BETWEEN, text.lower()) if x], set()
        for t in L.NOTICES:
            for s in range(1 - len(t.words), len(w)):
                same = sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t.words))
                if same >= 0.75 * len(t.words) and f" {t.key} " in " " + " ".join(w[max(s, 0) : s + len(t.words)]) + " ":
                    own.add(t.label)
        want.append(",".join(sorted(own)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in L.scan(docs, L.NOTICES).orderBy("id").collect()] == want
    assert want[0] == "mpl-2.0"
