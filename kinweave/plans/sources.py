"""Queries through the sources and sinks, and relational primitives that the others do not show."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.operators.decide import half_of
from kinweave.plans import records as T
from kinweave.plans.registry import big, query
from kinweave.sources import files as S
from kinweave.sources.tables import table
from kinweave.staging import shared_dir

#: `half_of` of operators/decide.py in DuckDB.
HALF = "CAST(CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS BIGINT)"


def folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes with the session."""
    from kinweave.staging import _on_fs

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _on_fs(spark, path)
    fs.deleteOnExit(p)
    return path


@query(f"WITH {T.RAW_CTE} SELECT entity_id, business_name, business_address, country FROM raw_s1")
def tsv_round_trip(spark, d):
    """Records written as compressed tab-separated text, read again, and counted against the lines of the file."""
    path, columns = folder(spark, "tsv"), [f.name for f in S.RECORD.fields]
    T.raw_s1(spark, d).select(columns).write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(path)
    back = S.read_tsv(spark, path)
    # every part has a header
    parts = spark.read.text(path).select(F.input_file_name().alias("f")).distinct().count()
    S.check_row_count(spark, path, back, headers=parts)
    return back


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10")
def csv_scan(spark, d):
    """A lazy scan of comma-separated text, two of its columns and a filter."""
    path = folder(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").write.option("header", True).csv(path)
    return S.read_csv(spark, path, "p_partkey long, p_name string, p_brand string, p_size int").where("p_size >= 10").select("p_partkey", "p_name", "p_size")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def partition_pruned(spark, d):
    """A table laid out by a column: the filter on it chooses folders, the columns reach the scan."""
    path = folder(spark, "by-region")
    S.write_partitioned(table(spark, d, "nation").withColumn("country", F.col("n_regionkey").cast("string")), path)
    return S.read_country(spark, path, "2", ["n_nationkey", "n_name"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer")
def multi_part_read(spark, d):
    """Three files read as one table; a column that one of them alone has is null in the others."""
    c, paths = table(spark, d, "customer"), [folder(spark, f"part{i}") for i in range(3)]
    for i, path in enumerate(paths):
        c.where(F.col("c_custkey") % 3 == i).select("c_custkey", "c_name", *(["c_mktsegment"] if i == 1 else [])).write.parquet(path)
    return S.read_parts(spark, paths)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT CAST(c_acctbal AS DOUBLE), CAST(c_custkey AS VARCHAR), c_acctbal FROM customer")
def relaxed_union(spark, d):
    """Tables with other types and columns under one schema: the wider type of each column."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("k"), F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("balance"))
    return S.union_by_name(n, c, relaxed=True)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def chunked_counts(spark, d):
    """A grouping done in four chunks of its keys, one after another, in one written table."""
    return S.in_chunks(table(spark, d, "orders"), 4, "o_custkey", lambda x: x.groupBy("o_custkey").agg(F.count("*").alias("n")), folder(spark, "chunks"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part")
def streamed_concat(spark, d):
    """Two written tables streamed into one; a second call finds it done and does nothing."""
    a, b, path = folder(spark, "a"), folder(spark, "b"), folder(spark, "both")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.parquet(a)
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).write.parquet(b)
    S.check_room(spark, shared_dir(spark), 1 << 20)
    S.concat_parts(spark, [a, b], path)
    return S.once(spark, path, lambda: spark.range(0).select("id", F.lit("").alias("name")))


@query("WITH p AS (SELECT DISTINCT s_suppkey AS s1_id, CAST(n_nationkey AS VARCHAR) AS m_id FROM supplier JOIN nation ON s_nationkey = n_regionkey) SELECT s1_id, m_id FROM p")
def list_file(spark, d):
    """Pairs written as a file of lists, one row for every entity, and read from it again."""
    s, n, path = table(spark, d, "supplier"), table(spark, d, "nation"), folder(spark, "lists")
    pairs = s.join(n, s["s_nationkey"] == n["n_regionkey"]).select(F.col("s_suppkey").alias("s1_id"), F.col("n_nationkey").cast("string").alias("m_id"))
    S.write_lists(S.lists_per_entity(s.select(F.col("s_suppkey").alias("s1_id")), pairs), path)
    return S.read_pairs(S.read_csv(spark, path, "s1_id long, matched_entity_ids string", sep="\t").na.fill(""))


# primitives

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@query(f"SELECT c_custkey, {HALF.format('c_custkey')} AS half FROM customer WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 3")
def hash_sample(spark, d):
    """Three tenths of the customers, in two halves, both by a hash of the key alone."""
    h = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "customer").where(h % 10 < 3).select("c_custkey", half_of("c_custkey").alias("half"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, bool_or(o_totalprice > 300000) OVER (PARTITION BY o_custkey) AS any_large, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def indexed_orders(spark, d):
    """A row's place in its group, values replaced by a map, whether any row of the group is large, and a left join that keeps the rows as they are."""
    w = Window.partitionBy("o_custkey")
    status = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("at"), F.coalesce(F.try_element_at(status, F.col("o_orderstatus")), F.col("o_orderstatus")).alias("status"), F.max(F.col("o_totalprice") > 300000).over(w).alias("any_large"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return big(o.join(c, "o_custkey", "left").drop("o_custkey"), "at")


@query("SELECT l_orderkey, l_linenumber, CAST(x AS INTEGER) AS x, y FROM (SELECT l_orderkey, l_linenumber, unnest([l_quantity, l_tax * 100]) AS x, l_returnflag AS y FROM lineitem WHERE l_linenumber = 1)")
def two_column_explode(spark, d):
    """One row for each pair of elements of two arrays."""
    x = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_tax") * 100).alias("xs"), F.array("l_returnflag").alias("ys"))
    return x.select("l_orderkey", "l_linenumber", F.explode("xs").alias("x"), "ys").select("l_orderkey", "l_linenumber", F.round("x").cast("int").alias("x"), F.explode("ys").alias("y"))
