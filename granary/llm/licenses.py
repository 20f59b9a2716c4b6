"""License scans with a positional rare-token index.

Templates (short phrases and longer notices) are kept as postings: token ->
(template, offset). The document frequency of every template token is counted
over the whole corpus; a phrase is anchored at its rarest token, a notice at so
many of its rarest ones that no place with enough words lacks them all. A
document's words are looked up in the set of anchors; each anchor found at
position p proposes that the template starts at p - offset, and the other
postings are intersected at the same relative position. A phrase matches where
all of its words stand consecutively. A notice matches where at least
``coverage`` of its words do and its mandatory key phrase stands inside.

Everything is a column expression over the document's word array: no text is
shuffled, and a document with many places is as cheap as its length.

Rows: null texts count as empty; a document without places has null first_word
and last_word, empty labels and score 0. Repeated rows each get a row. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower

#: Words: runs of characters other than these, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

MAX_TEMPLATES, MAX_WORDS = 200, 200


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase of the contract: every word must stand
    key: str = ""  # what must stand inside a notice

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(BETWEEN, self.text.lower()) if w]


BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))

NOTICES = (
    Template("mit-notice", "released under the MIT License", key="mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", key="free of charge"),
    Template("apache-2.0", "licensed under the Apache License Version 2.0", key="apache license version"),
    Template("gpl-3.0", "this work is licensed under the GNU General Public License version 3", key="general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the GNU General Public License version 2", key="general public license version 2"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", key="lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", key="source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License v 2.0", key="mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", key="copy modify"),
    Template("cc-by", "licensed under the Creative Commons Attribution 4.0 International License", key="creative commons attribution"),
)


def words(text: Column) -> Column:
    """Split, without the empty strings that lead or trail."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def rarity(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[str, int]:
    """Documents with each template token, over all documents: one pass, one row of counts."""
    tokens = sorted({w for t in templates for w in t.words})
    held = docs.select(F.array_distinct(F.filter(words(F.col(text_col)), lambda w: w.isin(tokens))).alias("w"))
    found = held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {r["w"]: r["n"] for r in found}


def anchor(template: Template, df: dict[str, int]) -> int:
    """Offset of the word with the highest inverse document frequency; of equals the longest, then the first."""
    return anchors_of(template, df, 1.0)[0]


def anchors_of(template: Template, df: dict[str, int], coverage: float) -> list[int]:
    """Offsets of the rarest words, as many as needed: of n words with at least ``coverage`` standing, one of any n - ceil(coverage * n) + 1 does."""
    at = template.words
    need = len(at) if template.base else min(len(at), max(1, math.ceil(coverage * len(at))))
    return sorted(range(len(at)), key=lambda i: (df.get(at[i], 0), -len(at[i]), i))[: len(at) - need + 1]


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, df: dict[str, int] | None = None, coverage: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    if len(templates) > MAX_TEMPLATES or any(not 1 <= len(t.words) <= MAX_WORDS for t in templates):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of 1 to {MAX_WORDS} words")
    df = rarity(docs, templates, text_col) if df is None else df
    anchors = sorted({t.words[at] for t in templates for at in anchors_of(t, df, coverage)})
    found = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w").cast("bigint"))
    rare = F.filter(F.transform("w", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    found = found.withColumn("rare", rare)
    word = lambda p: F.get("w", p)

    def agreed(t: Template, start: Column) -> Column:
        return sum((F.coalesce(word(start + k) == x, F.lit(False)).cast("int") for k, x in enumerate(t.words)), F.lit(0))

    def by_word(x: str, at: int) -> Column:
        return F.transform(F.filter("rare", lambda p: word(p) == x), lambda p: p - at)

    def starts(t: Template) -> Column:
        proposed = F.array_distinct(F.concat(*[by_word(t.words[at], at) for at in anchors_of(t, df, coverage)]))
        if t.base:
            return F.filter(proposed, lambda s: (s >= 0) & (agreed(t, s) == len(t.words)))
        key = [w for w in re.split(BETWEEN, t.key.lower()) if w]
        joined = lambda s: F.concat(F.lit(" "), F.array_join(F.slice("w", F.greatest(s, F.lit(0)) + 1, F.lit(len(t.words)) + F.least(s, F.lit(0))), " "), F.lit(" "))
        return F.filter(proposed, lambda s: (s + len(t.words) > 0) & (agreed(t, s) >= coverage * len(t.words)) & joined(s).contains(f" {' '.join(key)} "))

    base = [t for t in templates if t.base]
    own = [t for t in templates if not t.base]
    columns = {f"b{k}": starts(t) for k, t in enumerate(base)} | {f"o{k}": F.size(starts(t)) for k, t in enumerate(own)}
    found = found.select("id", "n_words", *[c.alias(n) for n, c in columns.items()])
    places = F.concat(*[F.col(f"b{k}") for k in range(len(base))]) if base else F.array().cast("array<int>")
    labels_of = lambda group, name: [F.when((F.size(f"{name}{k}") if name == "b" else F.col(f"{name}{k}")) > 0, t.label) for k, t in enumerate(group)]
    joined = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull()))), ",") if cols else F.lit("")
    sure, likely = labels_of(base, "b"), labels_of(own, "o")
    out = found.select(
        "id",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        joined(sure).alias("base_labels"),
        joined(sure + likely).alias("labels"),
        F.size(F.filter(F.array(*likely), lambda x: x.isNotNull())).alias("notices"),
    )
    score = F.when(F.col("notices") > 0, 1.0).when(F.col("n_base") > 0, 0.8).otherwise(0.0)
    return out.select("id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", score.alias("score"))
