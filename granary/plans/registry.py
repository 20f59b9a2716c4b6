"""Every query of the table store over the test tables, with its oracle in DuckDB SQL.

The queries call the same operators as the Database class; the test tables
stand in for its tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.errors import ConstraintError, StoreError, UnknownTable
from granary.functions import convert, types
from granary.functions.types import Column
from granary.operators import constraints, dml, nested, relations, scan
from granary.operators.relations import Relationship
from granary.operators.staging import shared_folder, staged
from granary.sources.database import Database, Index
from granary.sources.links import Link, LinkPolicy

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The test tables of one folder, and their column definitions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def placed(self, name: str) -> DataFrame:
        """With each row's place, as the store reads rows that it is to change."""
        return getattr(self, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def columns(df: DataFrame, **kinds: str) -> list[Column]:
    return [Column(f.name, kinds[f.name]) if f.name in kinds else types.from_spark(f) for f in df.schema.fields]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 1996 as objects: a projected scan with a pushed-down filter."""
    return filter_year(spark, sf_dir)


# Scans and projections


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def scan_typed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("""select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, printf('%.4f', o_totalprice) as o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders""")
def rows_as_strings(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    return scan.as_strings(orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(19,4)")), columns(orders, o_totalprice="currency"))


@query("select l_orderkey, l_linenumber, regexp_replace(cast(l_quantity as varchar), '[.]0$', '') as quantity, case when l_quantity > 25 then 'True' else 'False' end as large from lineitem")
def double_general_text(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", convert.number_text(F.col("l_quantity")).alias("quantity"), convert.bool_text(F.col("l_quantity") > 25).alias("large"))


@dataclass
class Customer:
    c_CustKey: int
    c_Name: str | None
    Visits: int = 3
    Note: str | None = None


@query("select c_custkey as \"c_CustKey\", c_name as \"c_Name\", 3::bigint as \"Visits\", null::varchar as \"Note\" from customer")
def poco_projection(spark, sf_dir):
    return scan.shaped(Tables(spark, sf_dir).customer, Customer)


@query("select o_orderkey, o_custkey, o_totalprice from orders where year(o_orderdate) = 1996")
def filter_year(spark, sf_dir):
    """The year is asked as a range, which reaches the scan."""
    day = F.col("o_orderdate")
    return Tables(spark, sf_dir).orders.filter((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderkey limit 25")
def where_take(spark, sf_dir):
    return Tables(spark, sf_dir).orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey limit 1")
def first_row(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(1)


@query("select count(*) as n from lineitem where l_quantity >= 30")
def count_where(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.filter(F.col("l_quantity") >= 30).agg(F.count("*").alias("n"))


@query("select count(*) > 0 as found from lineitem where l_quantity > 49")
def any_where(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.filter(F.col("l_quantity") > 49).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("found"))


@query("select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer where nullif(c_mktsegment, 'BUILDING') is not distinct from null")
def null_safe_predicate(spark, sf_dir):
    df = Tables(spark, sf_dir).customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return df.filter(dml.equals(columns(df), "segment", None))


@query("select c_custkey from customer where false")
def predicate_of_other_type(spark, sf_dir):
    """A whole number never equals a Double cell."""
    df = Tables(spark, sf_dir).customer
    return df.filter(dml.equals(columns(df), "c_acctbal", 0)).select("c_custkey")


@query("select n_nationkey, n_name from nation where lower(n_name) = 'nation_3' and lower(cast(n_regionkey as varchar)) = '3'")
def parent_key_predicate(spark, sf_dir):
    df = Tables(spark, sf_dir).nation
    return df.filter(dml.same_text(df, {"n_name": "NATION_3", "n_regionkey": 3})).select("n_nationkey", "n_name")


# Catalog and statistics


@query(" union all ".join(f"select '{t}' as table_name, (select count(*) from {t}) as row_count, (select count(*) from information_schema.columns where table_name = '{t}' and table_schema = current_schema())::int as column_count" for t in TABLES))
def table_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    each = [getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(len(getattr(t, n).columns)).alias("column_count")) for n in TABLES]
    return reduce(DataFrame.unionByName, each)


@query("select 14::bigint as table_count, " + " + ".join(f"(select count(*) from {t})" for t in TABLES) + " as total_rows")
def database_stats(spark, sf_dir):
    return table_stats(spark, sf_dir).agg(F.count("*").alias("table_count"), F.sum("row_count").alias("total_rows"))


def attached(spark, sf_dir, *names: str) -> Database:
    """A new database that has the test tables as external ones."""
    db = Database.create(spark, shared_folder(spark, "db"))
    with db.begin():
        for n in names:
            db.register(n, f"{sf_dir}/{n}.parquet")
    return db


@query("""select table_name, column_name as name, (ordinal_position - 1)::int as ordinal,
    case data_type when 'INTEGER' then 'Long Integer' when 'BIGINT' then 'Large Number' when 'DOUBLE' then 'Double' when 'VARCHAR' then 'Memo' else 'Date/Time' end as type_name
    from information_schema.columns where table_name in ('orders', 'nation', 'lineitem') and table_schema = current_schema()""")
def column_metadata(spark, sf_dir):
    return attached(spark, sf_dir, "orders", "nation", "lineitem").table("SysColumns").select("table_name", "name", "ordinal", "type_name")


@query("select 'nation' as table_name, count(*) as live_rows from nation union all select 'region', count(*) from region")
def real_row_counts(spark, sf_dir):
    db = attached(spark, sf_dir, "nation", "region")
    return spark.createDataFrame([(n, db.real_row_count(n)) for n in db.list_tables()], "table_name string, live_rows long")


# Writing: defaults, counters, checks


@query("select r_regionkey, coalesce(nullif(r_name, (select min(r_name) from region)), 'none') as r_name from region")
def insert_defaults(spark, sf_dir):
    region = Tables(spark, sf_dir).region
    least = region.agg(F.min("r_name").alias("least"))
    rows = region.join(F.broadcast(least)).select("r_regionkey", F.nullif("r_name", "least").alias("r_name"))
    return constraints.with_defaults(rows, [Column("r_regionkey", "int32"), Column("r_name", "text", default="none")])


@query("select n_name, case when n_nationkey % 2 = 0 then n_nationkey else ((select max(n_nationkey) from nation) + row_number() over (partition by n_nationkey % 2 order by n_name))::int end as id from nation")
def insert_autonumber(spark, sf_dir):
    """Null cells are numbered after the highest value, in order of name."""
    nation = Tables(spark, sf_dir).nation
    high = nation.agg(F.max("n_nationkey")).first()[0]
    return constraints.numbered(nation.select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("id")), "id", high, ["n_name"])


@query("select p_partkey, p_name, p_size from part union all select p_partkey + 1000000, p_name, null::int from part where p_size < 5")
def insert_batch_union(spark, sf_dir):
    """A batch without one of the columns is appended; the missing cells are null."""
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_size")
    batch = part.filter("p_size < 5").select((F.col("p_partkey") + 1_000_000).alias("P_PARTKEY"), "p_name")
    return part.unionByName(constraints.coerced(batch, columns(part)))


@query("select p_partkey, substr(p_name, 1, 8) as p_name from part")
def text_clip(spark, sf_dir):
    return constraints.coerced(Tables(spark, sf_dir).part, [Column("p_partkey", "int64"), Column("p_name", "text", size=8)])


@query("select c_custkey, case when c_mktsegment is not distinct from 'BUILDING' then 'HOUSES' else c_mktsegment end as c_mktsegment, case when c_mktsegment is not distinct from 'BUILDING' then 0.0 else c_acctbal end as c_acctbal from customer")
def update_rows(spark, sf_dir):
    df = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    cols = columns(df)
    return dml.updated(df, cols, dml.equals(cols, "C_MKTSEGMENT", "BUILDING"), {"c_mktsegment": "HOUSES", "c_acctbal": 0.0})


@query("select c_custkey, c_name from customer where c_mktsegment is distinct from 'BUILDING'")
def delete_rows(spark, sf_dir):
    df = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment")
    return dml.remaining(df, dml.equals(columns(df), "c_mktsegment", "BUILDING")).select("c_custkey", "c_name")


@query("select n_nationkey, 'moved' as n_name from nation where n_nationkey = 7 union all select n_nationkey, n_name from nation where n_nationkey not in (3, 7) union all select 99, 'new'")
def stored_changes(spark, sf_dir):
    """Insert, update and delete through a database, in one transaction."""
    db = attached(spark, sf_dir, "nation")
    with db.begin():
        db.insert("nation", [{"n_nationkey": 99, "n_name": "new"}])
        db.update("nation", "n_nationkey", 7, {"n_name": "moved"})
        db.delete("nation", "n_nationkey", 3)
    return db.table("nation").select("n_nationkey", "n_name")


@query("select s_suppkey from supplier where nullif(s_nationkey, 3) is null")
def not_null_violations(spark, sf_dir):
    df = Tables(spark, sf_dir).supplier.select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey"))
    [(_, _, bad)] = constraints.broken([Column("s_suppkey", "int64"), Column("s_nationkey", "int32", nullable=False)])
    return df.filter(bad).select("s_suppkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity between 2 and 49)")
def rule_violations(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    [(_, _, bad)] = constraints.broken([Column("l_quantity", "double", rule=lambda c: c.between(2, 49))])
    return df.filter(bad)


@query("select l_orderkey, l_linenumber, count(*) as rows from lineitem group by all having count(*) > 1")
def unique_violations(spark, sf_dir):
    return constraints.duplicates(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("select upper(nullif(c_mktsegment, 'BUILDING')) as segment, c_nationkey, count(*) as rows from customer group by all having count(*) > 1")
def unique_violations_null_and_case(spark, sf_dir):
    df = Tables(spark, sf_dir).customer.select(F.nullif(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("x")).alias("segment"), "c_nationkey")
    return constraints.duplicates(df.withColumn("segment", F.nullif(F.upper("segment"), F.lit("BUILDING"))), ["segment", "c_nationkey"])


@query("select c_custkey, row_number() over (order by nullif(c_nationkey, 3) nulls first, c_acctbal desc nulls last, c_custkey)::bigint as place from customer order by place limit 100")
def index_order_asc_desc(spark, sf_dir):
    """The first 100 entries of an index: nulls come first ascending, and last descending."""
    df = Tables(spark, sf_dir).customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_acctbal")
    top = df.orderBy(F.asc_nulls_first("k"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(100)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("k"), F.desc_nulls_last("c_acctbal"), "c_custkey"))
    return top.select("c_custkey", place.cast("long").alias("place"))


@query("select c_custkey, row_number() over (order by nullif(c_nationkey, 3) nulls first, c_acctbal desc nulls last, c_custkey)::bigint as place from customer")
def index_order_whole(spark, sf_dir):
    """The place of every row in that index; ranges are counted, so no window spans the table."""
    df = Tables(spark, sf_dir).customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_acctbal", F.lit(None).cast("long").alias("place"))
    order = [F.asc_nulls_first("k"), F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")]
    return constraints.numbered(df, "place", 0, order).select("c_custkey", "place")


@query("select o_orderkey, o_custkey from orders where o_orderkey = 77")
def key_lookup(spark, sf_dir):
    return Tables(spark, sf_dir).orders.filter(F.col("o_orderkey") == 77).select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey = 77 and l_linenumber = 1")
def composite_key_lookup(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.filter((F.col("l_orderkey") == 77) & (F.col("l_linenumber") == 1)).select("l_orderkey", "l_linenumber", "l_partkey")


# Relationships

CUSTOMERS = "(select * from customer where c_custkey % 10 <> 0)"


@query(f"select o_orderkey, o_custkey from orders where not exists (select 1 from {CUSTOMERS} where c_custkey = o_custkey)")
def fk_orphans(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return relations.orphans(t.orders.select("o_orderkey", "o_custkey"), ("o_custkey",), t.customer.filter("c_custkey % 10 <> 0"), ("c_custkey",))


@query(f"select o_orderkey from orders where exists (select 1 from {CUSTOMERS} where c_custkey = o_custkey)")
def fk_valid(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return relations.matching(t.orders.select("o_orderkey", "o_custkey"), ("o_custkey",), t.customer.filter("c_custkey % 10 <> 0"), ("c_custkey",), "left_semi").select("o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where nullif(l_orderkey % 7, 0) is not null and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderkey % 5 <> 0)")
def fk_orphans_with_nulls(spark, sf_dir):
    """A null part of the key exempts a row."""
    t = Tables(spark, sf_dir)
    child = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey")).alias("ref"))
    return relations.orphans(child, ("ref",), t.orders.filter("o_orderkey % 5 <> 0"), ("o_orderkey",)).select("l_orderkey", "l_linenumber")


@query("select c_custkey from customer where c_custkey % 3 <> 0 and not exists (select 1 from customer e where e.c_custkey = customer.c_custkey + 1 and e.c_custkey < customer.c_custkey) and c_custkey > 100")
def batch_self_reference(spark, sf_dir):
    """In a table that refers to itself, only stored rows and earlier rows of the batch are parents: a reference forward is an orphan."""
    batch = Tables(spark, sf_dir).customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") + 1).alias("up")).filter("c_custkey > 100")
    stored = batch.filter("false")
    return relations.orphans_in_order(batch, ("up",), stored, ("c_custkey",), "c_custkey").select("c_custkey")


@query("select c_custkey from customer where c_custkey % 3 <> 0 and not exists (select 1 from customer e where e.c_custkey = customer.c_custkey + 1 and e.c_custkey < customer.c_custkey)")
def batch_self_reference_whole(spark, sf_dir):
    """The same with every customer in the batch."""
    batch = Tables(spark, sf_dir).customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") + 1).alias("up"))
    return relations.orphans_in_order(batch, ("up",), batch.filter("false"), ("c_custkey",), "c_custkey").select("c_custkey")


@query("select a.n_nationkey as a_key, b.n_nationkey as b_key from nation a join nation b on upper(a.n_name) = upper(b.n_name)")
def ci_key_join(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    a, b = n.select(F.lower("n_name").alias("n_name"), F.col("n_nationkey").alias("a_key")), n.select(F.upper("n_name").alias("name"), F.col("n_nationkey").alias("b_key"))
    return a.join(b, constraints.key(a, ["n_name"])[0] == constraints.key(b, ["name"])[0]).select("a_key", "b_key")


FAMILY = [Relationship("co", "customer", ("c_custkey",), "orders", ("o_custkey",), cascade_deletes=True), Relationship("ol", "orders", ("o_orderkey",), "lineitem", ("l_orderkey",), cascade_deletes=True)]
PLACE = ["__file", "__row"]


@query("""with c as (select c_custkey from customer where c_mktsegment = 'BUILDING'), o as (select o_orderkey from orders where o_custkey in (select * from c))
    select 'customer' as table_name, count(*) as rows from customer where c_custkey not in (select * from c)
    union all select 'orders', count(*) from orders where o_orderkey not in (select * from o) union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select * from o)""")
def cascade_delete_survivors(spark, sf_dir):
    """Rows left in each table after customers and, over two levels, their dependents are deleted."""
    t = Tables(spark, sf_dir)
    frames = {
        "customer": t.placed("customer").select("c_custkey", "c_mktsegment", *PLACE), "orders": t.placed("orders").select("o_orderkey", "o_custkey", *PLACE),
        "lineitem": t.placed("lineitem").select("l_orderkey", "l_linenumber", *PLACE),
    }
    doomed = staged(frames["customer"].filter(F.col("c_mktsegment") == "BUILDING"))
    gone = relations.cascade_deletes(frames, FAMILY, "customer", doomed, PLACE)
    left = [frames[n].join(gone[n].select(*PLACE), PLACE, "left_anti").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in frames]
    return reduce(DataFrame.unionByName, left)


@query("select l_orderkey, l_linenumber, case when l_suppkey <= 5 then l_suppkey + 1000000 else l_suppkey end as l_suppkey from lineitem")
def cascade_update(spark, sf_dir):
    t = Tables(spark, sf_dir)
    moved = t.supplier.filter("s_suppkey <= 5").select("s_suppkey", (F.col("s_suppkey") + 1_000_000).alias("new"))
    return relations.rekeyed(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), ("l_suppkey",), moved, ["s_suppkey"], ["new"])


@query("select c_custkey, count(*) as dependents from customer join orders on c_custkey = o_custkey where c_custkey < 50 group by c_custkey")
def restrict_dependents(spark, sf_dir):
    """Orders that keep a customer from being deleted."""
    t = Tables(spark, sf_dir)
    doomed = t.customer.filter("c_custkey < 50").select("c_custkey")
    held = relations.matching(t.orders.select("o_custkey"), ("o_custkey",), doomed, ("c_custkey",), "left_semi")
    return held.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("dependents"))


@query("select c_custkey, count(*) as dependents from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by c_custkey")
def restrict_dependents_segment(spark, sf_dir):
    """The same for a share of the customers that grows with the table."""
    t = Tables(spark, sf_dir)
    doomed = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    held = relations.matching(t.orders.select("o_custkey"), ("o_custkey",), doomed, ("c_custkey",), "left_semi")
    return held.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("dependents"))


@query("select 'co' as name, 0 as icolumn, 'orders' as child, 'customer' as parent, 'o_custkey=c_custkey' as pairs union all select 'ol', 0, 'lineitem', 'orders', 'l_orderkey=o_orderkey'")
def relationship_rows(spark, sf_dir):
    """Relationships gathered from their catalog rows in order of column."""
    db = attached(spark, sf_dir, "customer", "orders", "lineitem")
    for r in FAMILY:
        db.create_relationship(r)
    pair = F.struct("icolumn", F.concat("child_column", F.lit("="), "parent_column").alias("p"))
    grouped = db.table("SysRelationships").groupBy("name", "child", "parent").agg(F.min("icolumn").alias("icolumn"), F.sort_array(F.collect_list(pair)).alias("l"))
    return grouped.select("name", "icolumn", "child", "parent", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("pairs"))


# Schema changes


@query("select p_partkey, p_name, null::int as p_rank from part")
def add_column(spark, sf_dir):
    db = attached(spark, sf_dir, "part")
    db.add_column("part", Column("p_rank", "int32", default=1))
    return db.table("part").select("p_partkey", "p_name", "p_rank")


@query("select p_partkey, p_brand, p_type, p_size, p_retailprice from part")
def drop_column(spark, sf_dir):
    db = attached(spark, sf_dir, "part")
    db.drop_column("part", "P_NAME")
    return db.table("part")


@query("select p_partkey, p_name as p_title, p_brand, p_type, p_size, p_retailprice from part")
def rename_column(spark, sf_dir):
    db = attached(spark, sf_dir, "part")
    db.rename_column("part", "p_name", "p_title")
    return db.table("part")


@query("select p_partkey, '\"' || replace(p_name, '\"', '\"\"') || '\"' as name_default, cast(p_size as varchar) as size_default from part")
def default_expressions(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", convert.expression_column(F.col("p_name"), "text").alias("name_default"), convert.expression_column(F.col("p_size"), "int32").alias("size_default"))


@query("select o_orderkey, '#' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '#' as date_default from orders")
def default_expression_dates(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", convert.expression_column(F.col("o_orderdate"), "datetime").alias("date_default"))


# Conversions


@query("select p_partkey, hex(encode(p_name)) as hex_text from part")
def binary_hex(spark, sf_dir):
    df = Tables(spark, sf_dir).part.select("p_partkey", F.encode("p_name", "UTF-8").alias("b"))
    return df.select("p_partkey", convert.as_text(F.col("b"), Column("b", "binary")).alias("hex_text"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'application/pdf' when p_partkey % 3 = 1 then 'image/png' else 'application/octet-stream' end as media from part")
def ole_mime(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 3 == 0, F.unhex(F.lit("25504446"))).when(F.col("p_partkey") % 3 == 1, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit("00")))
    return Tables(spark, sf_dir).part.select("p_partkey", convert.media_type(F.concat(head, F.encode("p_name", "UTF-8"))).alias("media"))


@query("select page_id, 'data:application/octet-stream;base64,' || base64(encode(url)) as uri from pages")
def ole_data_uri(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", convert.data_uri(F.encode("url", "UTF-8")).alias("uri"))


@query("select page_id, hex(encode(url)) as round_trip from pages")
def text_to_bytes(spark, sf_dir):
    """Base64 data URIs, plain hexadecimal and hexadecimal with dashes all come back as bytes."""
    raw = F.encode("url", "UTF-8")
    dashed = F.regexp_replace(F.hex(raw), "(..)(?=.)", "$1-")
    text = F.when(F.col("page_id") % 3 == 0, convert.data_uri(raw)).when(F.col("page_id") % 3 == 1, F.hex(raw)).otherwise(dashed)
    return Tables(spark, sf_dir).pages.select("page_id", F.hex(convert.parse_bytes(text)).alias("round_trip"))


@query("select o_orderkey, date_diff('day', date '1899-12-30', o_orderdate::date)::int as days from orders")
def oadate(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", convert.oa_days(F.col("o_orderdate")).alias("days"))


@query("select event_id, date_diff('day', date '1899-12-30', ts::date)::int as days, true as close from events")
def oadate_fraction(spark, sf_dir):
    """Days with their fraction, and whether the way back is right to a millisecond."""
    at = convert.oa_date(F.col("ts"))
    apart = F.unix_micros(convert.from_oa_date(at).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return Tables(spark, sf_dir).events.select("event_id", F.floor(at).cast("int").alias("days"), (F.abs(apart) < 1000).alias("close"))


@query("select event_id, try_cast(t as int) as whole, try_cast(t as double) as number from (select event_id, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then 'x' || event_id else cast(event_id as varchar) end as t from events)")
def parse_typed_lenient(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string"))
    return Tables(spark, sf_dir).events.select("event_id", convert.parse_text(text, Column("w", "int32"), strict=False).alias("whole"), convert.parse_text(text, Column("d", "double"), strict=False).alias("number"))


@query("select event_id, event_id::int as whole, event_id % 2 = 0 as flag from events")
def parse_typed_strict(spark, sf_dir):
    n = F.col("event_id")
    return Tables(spark, sf_dir).events.select("event_id", convert.parse_text(n.cast("string"), Column("w", "int32")).alias("whole"), convert.parse_text(convert.bool_text(n % 2 == 0), Column("b", "bool")).alias("flag"))


LINK = "case page_id % 4 when 0 then url when 1 then 'Page' || chr(35) || split_part(url, '#', 1) when 2 then 'Page#' || split_part(url, '#', 1) || '#part#tip' else '##anchor' end"


@query(f"""select page_id, case when page_id % 4 = 0 and instr(url, '#') = 0 then '' else split_part(h, '#', 1) end as display_text, case when page_id % 4 = 0 and instr(url, '#') = 0 then h else split_part(h, '#', 2) end as address,
    split_part(h, '#', 3) as sub_address, split_part(h, '#', 4) as screen_tip from (select page_id, url, {LINK} as h from pages)""")
def hyperlink_parse(spark, sf_dir):
    return links_of(spark, sf_dir).select("page_id", "link.*")


def links_of(spark, sf_dir) -> DataFrame:
    n, bare = F.col("page_id"), F.split_part("url", F.lit("#"), F.lit(1))
    text = F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("Page#"), bare)).when(n % 4 == 2, F.concat(F.lit("Page#"), bare, F.lit("#part#tip"))).otherwise("##anchor")
    return Tables(spark, sf_dir).pages.select("page_id", convert.hyperlink_parse(text).alias("link"))


@query(f"select page_id, case when page_id % 4 = 0 and instr(url, '#') = 0 then '#' || h else h end as text from (select page_id, url, {LINK} as h from pages)")
def hyperlink_format(spark, sf_dir):
    return links_of(spark, sf_dir).select("page_id", convert.hyperlink_text(F.col("link")).alias("text"))


@query("select p_partkey, '{' || substr(md5(cast(p_partkey as varchar)), 1, 8) || '}' as guid, printf('%.4f', p_partkey / 4.0) as money from part")
def guid_and_currency_text(spark, sf_dir):
    n = F.col("p_partkey")
    return Tables(spark, sf_dir).part.select("p_partkey", convert.guid_text(F.substring(F.md5(n.cast("string")), 1, 8)).alias("guid"), convert.currency_text(n / 4).alias("money"))


# Nested columns and links


@query("select o_orderkey, array_to_string(list_sort(list(l_partkey)), ',') as parts from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def multi_value_collect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gathered = nested.gathered(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey", "parts")
    return t.orders.select("o_orderkey").join(gathered, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("select l_orderkey, l_partkey as value from lineitem")
def multi_value_explode(spark, sf_dir):
    gathered = nested.gathered(Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey", "parts")
    return nested.flat(gathered, ["l_orderkey"], "parts")


@query("select c_custkey, count(o_orderkey) as files, coalesce(min(o_orderkey), -1) as first_file from customer left join orders on c_custkey = o_custkey group by c_custkey")
def attachments_per_parent(spark, sf_dir):
    """Every attachment of a parent comes back, and parents without any stay."""
    t = Tables(spark, sf_dir)
    item = F.struct(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file_name"), F.lit("txt").alias("file_type"))
    files = nested.gathered(t.orders.select("o_custkey", item.alias("item")), ["o_custkey"], "item", "files")
    rows = t.customer.select("c_custkey").join(files, F.col("c_custkey") == F.col("o_custkey"), "left")
    first = F.coalesce(F.get("files", F.lit(0))["file_name"].cast("bigint"), F.lit(-1).cast("bigint"))
    return rows.select("c_custkey", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("files"), first.alias("first_file"))


@query("select l_orderkey, l_linenumber, o_orderpriority, p_name from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey and p_size < 10")
def complex_catalog_join(spark, sf_dir):
    """An inner and an optional join, as complex columns are met with their catalog and names."""
    t = Tables(spark, sf_dir)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(t.part.filter("p_size < 10").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "p_name")


@query("select n_nationkey, n_name, n_regionkey from nation")
def linked_table_read(spark, sf_dir):
    far = attached(spark, sf_dir, "nation")
    near = attached(spark, sf_dir)
    near.links = LinkPolicy(allowed=(far.storage.root,))
    near.add_link(Link("Countries", "database", far.storage.root, "nation"))
    return near.table("countries")


@query("select 'Customers' as name, false as is_odbc, 'far' as source union all select 'Dsn', true, ''")
def linked_tables(spark, sf_dir):
    db = attached(spark, sf_dir)
    db.create_link("Customers", "far")
    db.create_odbc_link("Dsn", "DSN=x")
    return spark.createDataFrame([(x.name, x.is_odbc, x.source) for x in db.linked_tables()], "name string, is_odbc boolean, source string")


@query("select count(distinct lower(c_mktsegment)) as segments from (select c_mktsegment from customer union all select lower(c_mktsegment) from customer)")
def distinct_without_case(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_mktsegment")
    both = c.union(c.select(F.lower("c_mktsegment")))
    return both.select(F.lower("c_mktsegment").alias("s")).dropDuplicates(["s"]).agg(F.count("*").alias("segments"))


@query("select 'order details' as raw, 'OrderDetails' as name union all select '2nd-name', '_2ndName' union all select '__', 'Unknown' union all select 'Customer', 'Customer'")
def pascal_case_names(spark, sf_dir):
    return spark.createDataFrame([(n, convert.pascal_case(n)) for n in ("order details", "2nd-name", "__", "Customer")], "raw string, name string")


@query("select doc_id, length(text) as n_chars from documents")
def attachment_round_trip(spark, sf_dir):
    """Texts stored as attachments, deflated unless their type is compressed already, and read back."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("zip").alias("kind"))
    back = convert.unwrap_attachments(convert.wrap_attachments(docs, "raw", "kind", "stored").select("doc_id", "stored"), "stored", "file")
    return back.select("doc_id", F.char_length(F.decode("file", "UTF-8")).cast("long").alias("n_chars"))


# Through the Database class: what it stores, refuses and reports


def fresh(spark, tag: str = "store") -> Database:
    return Database.create(spark, shared_folder(spark, tag))


def refused(change, kind: type = StoreError) -> str:
    """What a change raises, as text; empty where it is taken."""
    try:
        change()
    except kind as e:
        return str(e)
    return ""


@query("""select (case when c_custkey = 7 then 1000007 else c_custkey end)::int as "Id", (case when c_custkey <= 40 then null when c_custkey % 40 + 1 = 7 then 1000007 else c_custkey % 40 + 1 end)::int as "Up", c_name as "Label" from customer""")
def stored_update_cascade_self(spark, sf_dir):
    """A key moves, and with it the references to it in the same table."""
    db, customer = fresh(spark), Tables(spark, sf_dir).customer
    db.create_table("Node", [Column("Id", "int32", primary=True), Column("Up", "int32"), Column("Label", "text", size=100)])
    up = F.when(F.col("c_custkey") > 40, F.col("c_custkey") % 40 + 1)
    db.insert("Node", customer.select(F.col("c_custkey").cast("int").alias("Id"), up.cast("int").alias("Up"), F.col("c_name").alias("Label")))
    db.create_relationship(Relationship("R", "Node", ("Id",), "Node", ("Up",), cascade_updates=True))
    db.update("Node", "Id", 7, {"Id": 1000007})
    return db.table("Node")


@query("""select (s_suppkey + 1)::int as "Key", s_name as "Name", abs(s_nationkey)::int as "Points" from supplier where s_suppkey % 5 <> 0
    union all select (select max(s_suppkey) from supplier)::int + 2, 'late', 3""")
def stored_rename_rules(spark, sf_dir):
    """Renamed columns keep their rule and their counter, also after the highest number was deleted."""
    db, t = fresh(spark, "re named"), Tables(spark, sf_dir)
    db.create_table("Supplier List", [Column("Id", "int32", auto=True), Column("Name", "text", size=100), Column("Score", "int32", rule=lambda c: c >= 0)])
    s = t.supplier.select((F.col("s_suppkey") + 1).cast("int").alias("Id"), F.col("s_name").alias("Name"), F.abs("s_nationkey").cast("int").alias("Score"))
    db.insert("Supplier List", s.filter("(Id - 1) % 5 <> 0"))
    top = t.supplier.agg(F.max("s_suppkey")).first()[0] + 1
    db.delete("Supplier List", "Id", top)
    if top % 5 != 1:
        db.insert("Supplier List", s.filter(F.col("Id") == top))
    else:
        db.insert("Supplier List", [(top, "gone", 1)])
        db.delete("Supplier List", "Id", top)
    db.rename_column("Supplier List", "Id", "Key")
    db.rename_column("Supplier List", "Score", "Points")
    assert "breaks its rule" in refused(lambda: db.insert("Supplier List", [(None, "bad", -5)]), ConstraintError)
    db.insert("Supplier List", [(None, "late", 3)])
    return db.table("supplier list")


@query("""select c_custkey, case when c_mktsegment = 'BUILDING' then 'moved' else c_name end as c_name, c_mktsegment from customer where c_mktsegment is distinct from 'MACHINERY'""")
def stored_space_path(spark, sf_dir):
    """Updates and deletes of a table whose name and place hold blanks and signs."""
    db, t = fresh(spark, "a b+c%"), Tables(spark, sf_dir)
    db.create_table("All Customers", [Column("c_custkey", "int64", primary=True), Column("c_name", "text", size=100), Column("c_mktsegment", "text", size=50)])
    db.insert("All Customers", t.customer.select("c_custkey", "c_name", "c_mktsegment"))
    db.update("All Customers", "c_mktsegment", "BUILDING", {"c_name": "moved"})
    db.delete("All Customers", "c_mktsegment", "MACHINERY")
    db.compact("All Customers")
    return Database.open(spark, db.storage.root).table("all customers")


@query("""select 'Customers' as table_name, (select count(*) from customer where c_mktsegment is distinct from 'BUILDING') as row_count, 2 as column_count, (select count(*) from customer where c_mktsegment is distinct from 'BUILDING') as counted
    union all select 'Parts', (select count(*) from part), 1, (select count(*) from part)""")
def stored_stats(spark, sf_dir):
    """The manifest's counters after inserts and a delete, beside the rows that are there."""
    db, t = fresh(spark), Tables(spark, sf_dir)
    db.create_table("Customers", [Column("Id", "int64"), Column("Segment", "text", size=50)])
    db.create_table("Parts", [Column("Id", "int64")])
    db.create_table("Gone", [Column("Id", "int64")])
    db.insert("Customers", t.customer.select(F.col("c_custkey").alias("Id"), F.col("c_mktsegment").alias("Segment")))
    db.insert("Parts", t.part.select(F.col("p_partkey").alias("Id")))
    db.delete("Customers", "Segment", "BUILDING")
    db.drop_table("Gone")
    counted = spark.createDataFrame([(n, db.real_row_count(n)) for n in db.list_tables()], "table_name string, counted long")
    return db.table_stats().join(F.broadcast(counted), "table_name")


@query("""select * from (values ('ByName', 'normal', false, true, false, 'Name desc,Id asc'), ('PrimaryKey', 'primary', true, false, true, 'Id asc'), ('R', 'foreign key', false, false, false, 'Up asc')) t(name, kind, is_unique, ignore_nulls, required, columns)""")
def stored_indexes(spark, sf_dir):
    db = fresh(spark)
    db.create_table("T", [Column("Id", "int32", primary=True), Column("Name", "text"), Column("Up", "int32")], [Index("ByName", ("Name", "Id"), descending=("Name",), ignore_nulls=True)])
    db.create_relationship(Relationship("R", "T", ("Id",), "T", ("Up",)))
    return Database.open(spark, db.storage.root).index_metadata("T").select("name", "kind", "is_unique", "ignore_nulls", "required", F.array_join("key_columns", ",").alias("columns"))


FULL = [
    Column("Id", "int32", auto=True, primary=True), Column("Name", "text", size=40, nullable=False, allow_empty=False, description="a name"), Column("Price", "decimal", precision=12, scale=3, default=1, rule_text=">0", rule_message="too low"),
    Column("Memo", "memo"), Column("Flag", "bool"), Column("Raw", "binary", size=9), Column("At", "datetime"), Column("G", "guid"), Column("Tags", "multivalue", element="text"), Column("Files", "attachment"),
]


@query("""select * from (values ('Id', 0, 4, 'Long Integer', 'int32', '4 bytes', null::int, null::int, false, true, true, null, null, null, null, true, null, null),
    ('Name', 1, 10, 'Text', 'text', '40 chars', null, null, false, false, false, null, null, null, 'a name', false, null, null), ('Price', 2, 16, 'Decimal', 'decimal', '17 bytes', 12, 3, true, false, false, '1', '>0', 'too low', null, true, null, null),
    ('Memo', 3, 12, 'Memo', 'memo', 'LVAL', null, null, true, false, false, null, null, null, null, true, null, null), ('Flag', 4, 1, 'Yes/No', 'bool', '1 bit', null, null, true, false, false, null, null, null, null, true, null, null),
    ('Raw', 5, 9, 'Binary', 'binary', '9 bytes', null, null, true, false, false, null, null, null, null, true, null, null), ('At', 6, 8, 'Date/Time', 'datetime', '8 bytes', null, null, true, false, false, null, null, null, null, true, null, null),
    ('G', 7, 15, 'GUID', 'guid', '16 bytes', null, null, true, false, false, null, null, null, null, true, null, null), ('Tags', 8, 18, 'Complex', 'multivalue', '4 bytes', null, null, true, false, false, null, null, null, null, true, 'text', null),
    ('Files', 9, 17, 'Attachment', 'attachment', '4 bytes', null, null, true, false, false, null, null, null, null, true, null, null))
    t(name, ordinal, type_code, type_name, kind, size, "precision", scale, "nullable", auto, "primary", default_value, rule, rule_message, description, allow_empty, element, expression)""")
def stored_column_metadata(spark, sf_dir):
    """All eighteen fields, from a database opened anew: every property is persisted."""
    db = fresh(spark)
    db.create_table("T", FULL)
    return Database.open(spark, db.storage.root).column_metadata("T")


@query("""with p as (select count(*) as n, count(*) filter (p_size % 7 = 0) as sevens, count(*) filter (p_size > 40) as big from part)
    select 'default before null' as what, n as found from p union all select 'null', sevens from p union all select 'rule', big from p union all select 'duplicate in batch', 1 from p union all select 'key stored already', 1 from p
    union all select 'update to a held key', 1 from p union all select 'rows that stay', n from p""")
def stored_checks(spark, sf_dir):
    """What inserts and updates refuse, and with how many rows; refused ones change nothing."""
    db, part = fresh(spark), Tables(spark, sf_dir).part
    db.create_table("P", [Column("Id", "int64", primary=True), Column("Size", "int32", nullable=False, default=1)])
    db.create_table("Q", [Column("Id", "int64"), Column("Size", "int32", nullable=False)])
    db.create_table("R", [Column("Size", "int32", rule=lambda c: c <= 40)])
    sevens = F.when(F.col("p_size") % 7 != 0, F.col("p_size")).cast("int").alias("Size")
    rows = part.select(F.col("p_partkey").alias("Id"), sevens)
    count = lambda text: int(text.rpartition("(")[2].split()[0]) if text else 0
    found = [("default before null", db.insert("P", rows))]
    found.append(("null", count(refused(lambda: db.insert("Q", rows)))))
    found.append(("rule", count(refused(lambda: db.insert("R", part.select(F.col("p_size").cast("int").alias("Size")))))))
    found.append(("duplicate in batch", int("repeats a key" in refused(lambda: db.insert("P", [(-1, 1), (-1, 2)])))))
    found.append(("key stored already", int("holds a key already" in refused(lambda: db.insert("P", rows.limit(1))))))
    found.append(("update to a held key", int("Unique" in refused(lambda: db.update("P", "Id", 1, {"Id": 2})))))
    found.append(("rows that stay", db.real_row_count("P") + db.real_row_count("Q") + db.real_row_count("R")))
    return spark.createDataFrame(found, "what string, found long")


@query("""select * from (values ('eleven columns', true), ('no column', true), ('unknown column', true), ('column twice', true), ('attachment', true), ('memo', false), ('unknown descending', true), ('two primary keys', true), ('name twice', true)) t(what, is_refused)""")
def stored_index_rules(spark, sf_dir):
    db = fresh(spark)
    cols = [Column(f"C{k}", "int32") for k in range(11)] + [Column("M", "memo"), Column("F", "attachment")]
    cases = {
        "eleven columns": [Index("I", tuple(f"C{k}" for k in range(11)))], "no column": [Index("I", ())], "unknown column": [Index("I", ("Z",))], "column twice": [Index("I", ("C1", "c1"))], "attachment": [Index("I", ("F",))],
        "memo": [Index("I", ("M",))], "unknown descending": [Index("I", ("C1",), descending=("C2",))], "two primary keys": [Index("I", ("C1",), True, True), Index("J", ("C2",), True, True)], "name twice": [Index("I", ("C1",)), Index("i", ("C2",))],
    }
    return spark.createDataFrame([(what, bool(refused(lambda i=i, n=n: db.create_table(f"T{n}", cols, i)))) for n, (what, i) in enumerate(cases.items())], "what string, is_refused boolean")


@query("""select 'enforced' as what, 0::bigint as taken union all select 'parents there', (select count(*) from nation) union all select 'switched off', (select count(*) from nation) union all select 'parent table gone', (select count(*) from nation)""")
def stored_relationship_switch(spark, sf_dir):
    """An enforced relationship refuses orphans; one that isn't, or whose parent is gone, takes them."""
    db, t, found = fresh(spark), Tables(spark, sf_dir), []
    child = t.nation.select(F.col("n_nationkey").cast("int").alias("Id"), F.col("n_regionkey").cast("int").alias("Region"))
    for what, enforce, fill, drop in (("enforced", True, False, False), ("parents there", True, True, False), ("switched off", False, False, False), ("parent table gone", True, False, True)):
        p, c = f"P{len(found)}", f"C{len(found)}"
        db.create_table(p, [Column("Id", "int32", primary=True)])
        db.create_table(c, [Column("Id", "int32"), Column("Region", "int32")])
        db.create_relationship(Relationship(c, p, ("Id",), c, ("Region",), enforce=enforce))
        if fill:
            db.insert(p, t.region.select(F.col("r_regionkey").cast("int").alias("Id")))
        if drop:
            db.drop_table(p)
        refused(lambda c=c: db.insert(c, child), ConstraintError)
        found.append((what, db.real_row_count(c)))
    return spark.createDataFrame(found, "what string, taken long")


@query("""select 'guid' as kind, (select count(*) from customer where c_custkey % 3 = 0) as orphans union all select 'date', (select count(*) from orders where o_orderdate::date not in (select o_orderdate::date from orders where o_orderkey % 2 = 0))
    union all select 'decimal', (select count(*) from part where p_partkey % 4 <> 0)""")
def fk_key_kinds(spark, sf_dir):
    """Keys of other kinds are equal by value: GUIDs without case, dates, decimals of different scales."""
    t = Tables(spark, sf_dir)
    guid = lambda f: F.regexp_replace(F.md5(F.col("c_custkey").cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5").alias("k") if f is None else f(F.regexp_replace(F.md5(F.col("c_custkey").cast("string")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")).alias("k")
    guids = relations.orphans(t.customer.select(guid(None)), ("k",), t.customer.filter("c_custkey % 3 <> 0").select(guid(F.upper)), ("k",))
    day = F.date_trunc("day", "o_orderdate").alias("k")
    dates = relations.orphans(t.orders.select(day), ("k",), t.orders.filter("o_orderkey % 2 = 0").select(day), ("k",))
    decimals = relations.orphans(t.part.select(F.col("p_partkey").cast("decimal(18,4)").alias("k")), ("k",), t.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").cast("decimal(28,2)").alias("k")), ("k",))
    out = None
    for kind, rows in (("guid", guids), ("date", dates), ("decimal", decimals)):
        found = rows.agg(F.count("*").alias("orphans")).select(F.lit(kind).alias("kind"), "orphans")
        out = found if out is None else out.unionByName(found)
    return out


@query("""select 'tables' as what, 'Region,nation' as found union all select 'first row', r_name from region where r_regionkey = (select min(r_regionkey) from region) union all select 'all rows', ((select count(*) from nation) + (select count(*) from region))::varchar
    union all select 'rows as texts', (select count(*)::varchar from nation) union all select 'unknown', '0' union all select 'unknown, strict', 'refused' union all select 'watched', (select count(*)::varchar from nation) union all select 'limit', '2'
    union all select 'exists', 'refused' union all select 'no columns', 'refused' union all select 'calculated', 'refused'""")
def stored_reads(spark, sf_dir):
    """Ways to read, and what definitions refuse."""
    db, t = fresh(spark), Tables(spark, sf_dir)
    db.create_table("Region", [Column("Id", "int32", primary=True), Column("Name", "text", size=100)])
    db.insert("Region", t.region.select(F.col("r_regionkey").cast("int").alias("Id"), F.col("r_name").alias("Name")))
    db.register("nation", f"{sf_dir}/nation.parquet", primary=["n_nationkey"])
    rows, seen = db.watched("nation")
    rows.write.format("noop").mode("overwrite").save()
    no = lambda text: "refused" if text else "taken"
    found = [
        ("tables", ",".join(sorted(db.list_tables()))), ("first row", db.read().orderBy("Id").first()["Name"]), ("all rows", str(sum(x.count() for x in db.read_all().values()))), ("rows as texts", str(db.rows_as_strings("NATION").count())),
        ("unknown", str(db.table("nowhere").count())), ("unknown, strict", no(refused(lambda: db.table("nowhere", missing="raise"), UnknownTable))), ("watched", str(seen.get["rows"])), ("limit", str(db.first_table(2).count())),
        ("exists", no(refused(lambda: db.create_table("REGION", [Column("A", "int32")])))), ("no columns", no(refused(lambda: db.create_table("E", [])))), ("calculated", no(refused(lambda: db.create_table("E", [Column("A", "int32", expression="1")])))),
    ]
    return spark.createDataFrame(found, "what string, found string")


@query("""select l_orderkey, l_linenumber, printf('%.4f', l_quantity::decimal(18,4)) as quantity, printf('%.2f', l_extendedprice::decimal(18,2)) as price from lineitem""")
def decimal_text(spark, sf_dir):
    """Decimals as texts keep their scale."""
    n = lambda c, scale: convert.as_text(F.col(c).cast(f"decimal(18,{scale})"), Column(c, "decimal", precision=18, scale=scale))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", n("l_quantity", 4).alias("quantity"), n("l_extendedprice", 2).alias("price"))


@query("select doc_id, md5(coalesce(text, '')) as digest from documents")
def attachment_contents(spark, sf_dir):
    """Texts stored as attachments and read back, byte for byte."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("zip").alias("kind"))
    back = convert.unwrap_attachments(convert.wrap_attachments(docs, "raw", "kind", "stored").select("doc_id", "stored"), "stored", "file")
    return back.select("doc_id", F.md5("file").alias("digest"))


@query("select o_custkey as \"Id\", (o_orderkey::varchar || '.txt') as file_name, md5(o_orderpriority) as digest from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def stored_attachments(spark, sf_dir):
    """Attachments in a stored column, a row each; deleting a parent takes its items along."""
    db, t = fresh(spark), Tables(spark, sf_dir)
    db.create_table("C", [Column("Id", "int64", primary=True), Column("Segment", "text", size=50), Column("Files", "attachment")])
    kind = types.ATTACHMENT
    values = {"file_name": F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt")), "file_type": F.lit("txt"), "file_data": F.encode("o_orderpriority", "UTF-8")}
    item = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    files = t.orders.select("o_custkey", item.alias("item")).groupBy("o_custkey").agg(F.collect_list("item").alias("Files"))
    rows = t.customer.join(files, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("Id"), F.col("c_mktsegment").alias("Segment"), "Files")
    db.insert("C", rows)
    for segment in [r[0] for r in t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_mktsegment").distinct().collect()]:  # a handful of segments
        db.delete("C", "Segment", segment)
    return db.attachments("C", "Files").select("Id", "file_name", F.md5("file_data").alias("digest"))
