"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import chat, decontaminate, exact_dedup, licenses, mixing, quality, simhash, token_output, toxicity, url_filter
from granary.llm.common import shared_folder, staged

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_oracle() -> str:
    bias, weights = url_filter.default_model()
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    case = lambda at: " ".join(
        f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{(r, what)[at]}'" for what, r in rules
    )
    n = url_filter.GRAM
    return f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, {LOWERED.format("regexp_extract(r, '^[^/?#]*', 0)")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
model as (select [{", ".join(map(str, weights))}] as w),
scored as (select page_id, host, path, '^' || host || '$' || path as t from parts),
sums as (select page_id, host, path, cast({bias} + coalesce(list_sum(list_transform(range(1, length(t) - {n - 2}), lambda i: w[1 + ('0x' || substr(md5(substr(t, i, {n})), 1, 7))::bigint % {url_filter.BUCKETS}])), 0) as bigint) as margin from scored, model)
select page_id, host, path, case {case(0)} end as rule, coalesce(case {case(1)} end, case when margin > 0 then 'block' else 'allow' end) as verdict, margin from sums
"""


ORACLES["op2_url_filters"] = op2_oracle()


def tokens_of(docs: DataFrame, as_stored: bool = False) -> DataFrame:
    """Encodes docs into segments in the shared folder and reads them back, a row per document."""
    import public_tokenizers

    spark = docs.sparkSession
    path = shared_folder(spark, "segments")
    token_output.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), as_stored=as_stored)
    return token_output.read_tokens(spark, path).withColumnRenamed("doc", "doc_id")


@query
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index takes the whole table as its first batch, and goes when the result is written."""
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = staged(exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index, "first"), "kept")
    index.destroy()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op4_exact_dedup"] = f"""
with t as (select doc_id, sha256({LOWERED.format("coalesce(text, '')")}) as text_sha256 from documents),
w as (select doc_id, text_sha256, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) as r from t)
select doc_id, keep_id, group_size, r = 1 as kept, text_sha256 from w
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that leaks and item that it leaks; clean documents have none."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=decontaminate.SIMILARITY)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), *[F.col(c).cast("bigint").alias(c) for c in ("item_words", "overlap", "matched")])


def op6_oracle() -> str:
    """Aligns every word of every item with every equal word of every document."""
    words = f"list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    w, need, least = decontaminate.WINDOW, 11, decontaminate.MIN_WORDS
    return f"""
with docs as (select distinct doc_id, {words} as w from documents), items as (select * from (select distinct item_id, {words} as w from benchmark) where len(w) >= {least}),
dw as (select doc_id, len(w) as n, unnest(w) as token, unnest(range(len(w))) as i from docs), iw as (select item_id, len(w) as m, unnest(w) as token, unnest(range(len(w))) as j from items),
same as (select doc_id, item_id, n, m, i - j as d, j from dw join iw using (token)),
counted as (select *, count(*) over (partition by doc_id, item_id, d) as matched, count(*) over (partition by doc_id, item_id, d order by j range between current row and {w - 1} following) as run from same),
aligned as (select doc_id, item_id, m, d, any_value(matched) as matched, case when m >= {w} then max(run) else any_value(matched) end as overlap from counted
    where least(m, n - d) - greatest(-d, 0) >= least({w}, m) group by doc_id, item_id, n, m, d)
select doc_id, item_id, m::bigint as item_words, max(overlap)::bigint as overlap, max(matched)::bigint as matched from aligned where overlap >= case when m >= {w} then {need} else m end group by doc_id, item_id, m
"""


ORACLES["op6_benchmark_decontamination"] = op6_oracle()


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_oracle() -> str:
    templates = licenses.BASE + licenses.NOTICES
    postings = ", ".join(f"({t}, {k}, '{w}')" for t, x in enumerate(templates) for k, w in enumerate(x.words))
    about = ", ".join(f"({t}, '{x.label}', {x.base}, {len(x.words)}, ' {' '.join(w for w in x.key.split())} ')" for t, x in enumerate(templates))
    return f"""
with postings(t, k, token) as (values {postings}), about(t, label, base, n, key) as (values {about}),
docs as (select doc_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
each as (select doc_id, unnest(w) as token, unnest(range(len(w))) as pos from docs),
words as (select * from each where token in (select token from postings)),
df as (select token, count(distinct doc_id) as df from words group by token),
anchors as (select t, arg_min(k, (coalesce(df, 0), -length(token), k)) as k, arg_min(token, (coalesce(df, 0), -length(token), k)) as token from postings left join df using (token) group by t),
proposed as (select doc_id, t, pos - k as s from words join anchors using (token)),
agreed as (select p.doc_id, p.t, p.s, count(*) as same from proposed p join postings o on o.t = p.t join words x on x.doc_id = p.doc_id and x.pos = p.s + o.k and x.token = o.token group by all),
matched as (select g.doc_id, g.s, a.label, a.base from agreed g join about a using (t) join docs d using (doc_id)
    where case when a.base then g.s >= 0 and g.same = a.n else g.s + a.n > 0 and g.same >= 0.75 * a.n
      and contains(' ' || array_to_string(d.w[greatest(g.s, 0) + 1 : g.s + a.n], ' ') || ' ', a.key) end),
summed as (select doc_id, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
    string_agg(distinct case when base then label end, ',' order by case when base then label end) as base_labels, string_agg(distinct label, ',' order by label) as labels, count(*) filter (not base) as notices from matched group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, case when notices > 0 then 1.0::double when n_base > 0 then 0.8::double else 0.0::double end as score from docs left join summed using (doc_id)
"""


ORACLES["op7_license_scans"] = op7_oracle()


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(staged(chat.format_chats(turns.unionByName(more)), "chats")).withColumnRenamed("conv", "conv_id")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


#: Target weights of the registered mix; every other source weighs 1.
WEIGHTS = {"src1": 2.0, "src2": 2.0, "src3": 0.5}


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, default_weight=1.0)


ORACLES["op9_mixing"] = f"""
with by_source as (select source, sum(greatest(coalesce(length(text), 0), 1)) as volume,
    case source {" ".join(f"when '{s}' then {w}::double" for s, w in WEIGHTS.items())} else 1.0::double end as weight from documents group by source),
rated as (select source, weight / sum(weight) over () * sum(volume::double) over () / volume as rate from by_source),
terms as (with recursive t(source, rate, k, p, c) as (
    select source, rate, 0, exp(-rate), exp(-rate) from rated
    union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from t where k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)) select * from t),
cdfs as (select source, list(c order by k) as cdf from terms group by source),
drawn as (select d.*, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17:' || d.doc_id || ':1'), 1, 13))::bigint / 4503599627370496.0::double)) as n
    from documents d join cdfs on d.source is not distinct from cdfs.source),
each as (select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) as copy from drawn)
select doc_id, text, lang, source, n_chars, copy::int as copy, ('0x' || substr(md5('17:' || doc_id || ':copy:' || copy), 1, 15))::bigint as shuffle_key from each
"""
