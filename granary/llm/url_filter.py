"""URL filters: host rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained on the driver from a small labelled URL table of at
most MAX_LABELLED rows; its weights are whole numbers in one constant array, so
scoring is a column expression without any shuffle and sums exactly.

Rows: a null url, or one without ://, has an empty host and path and is judged
by the method alone. Repeated urls are judged alike. An empty table gives an
empty result. Only the id and url columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, BUCKETS, SCALE = 4, 4096, 1_000_000
MAX_LABELLED, MAX_RULES = 2000, 500

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Host and path words of the labelled table: 1 is unwanted, 0 is not.
UNWANTED = ("spam-farm", "cheap-pills", "casino-bonus", "free-money", "adult-chat", "win-prizes", "payday-loans", "replica-watches", "click-here", "hot-deals", "porn-tube", "fake-degrees", "seo-links", "miracle-diet", "lottery-winner")
WANTED = ("news", "library", "university", "science", "recipes", "museum", "weather", "gardening", "history", "council", "hospital", "journal", "archive", "theatre", "railway")


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table: unwanted and ordinary hosts under the reserved example domains, with the same paths."""
    found = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for at, word in enumerate(words):
            for k, (sub, path) in enumerate((("", "/en/100"), ("www.", "/de/200.html"), ("blog.", "/fr/300/"), ("m.", "/es/400"))):
                found.append((f"http://{sub}{word}.example.{('com', 'org', 'net')[(at + k) % 3]}{path}", label))
    return found


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def buckets(url: str | None) -> list[int]:
    """The buckets of a url's n-grams, as margin() takes them."""
    rest = (url or "").partition("://")[2]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    text = "^" + "".join(c.lower() if "A" <= c <= "Z" else c for c in host) + "$" + path
    return [int(hashlib.md5(text[i : i + GRAM].encode()).hexdigest()[:7], 16) % BUCKETS for i in range(len(text) - GRAM + 1)]


def train(labelled: list[tuple[str, int]], epochs: int = 300, rate: float = 2.0, ridge: float = 1e-3) -> tuple[int, list[int]]:
    """Bias and weights as whole numbers (of 1 / SCALE), by full-batch gradient descent; features are counts of buckets."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls; {len(labelled)} given")
    rows = [(buckets(u), y) for u, y in labelled]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        slope, at = {}, 0.0
        for grams, y in rows:
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(w[g] for g in grams))))) - y
            at += e
            for g in grams:
                slope[g] = slope.get(g, 0.0) + e
        n = max(1, len(rows))
        b -= rate / 10 * at / n
        w = [x * (1 - rate * ridge) for x in w]
        for g, s in slope.items():
            w[g] -= rate * s / n
    return round(b * SCALE), [round(x * SCALE) for x in w]


@cache
def default_model() -> tuple[int, list[int]]:
    return train(labelled_urls())


def margin(host: Column, path: Column, model: tuple[int, list[int]]) -> Column:
    """Log-odds of an unwanted url, times SCALE."""
    bias, weights = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    text = F.concat(F.lit("^"), host, F.lit("$"), path)
    bucket = lambda i: F.conv(F.substring(F.md5(F.substring(text, i, F.lit(GRAM))), 1, 7), 16, 10).cast("int") % BUCKETS
    grams = F.sequence(F.lit(1), F.greatest(F.char_length(text) - GRAM + 1, F.lit(1)))
    total = F.aggregate(grams, F.lit(bias).cast("bigint"), lambda s, i: s + F.get(table, bucket(i)))
    return F.when(F.char_length(text) >= GRAM, total).otherwise(F.lit(bias).cast("bigint"))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as (pattern, action), else nulls; of equal patterns the first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; {len(rules)} given")
    pattern, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        pattern, action = F.when(fits, text).otherwise(pattern), F.when(fits, what).otherwise(action)
    return pattern, action


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: tuple[int, list[int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, margin."""
    host, path = parts(F.col("url"))
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    scored = split.withColumn("margin", margin(F.col("host"), F.col("path"), model or default_model()))
    pattern, action = rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("id", "host", "path", pattern.alias("rule"), verdict.alias("verdict"), "margin")
