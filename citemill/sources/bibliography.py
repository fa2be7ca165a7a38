"""Citations and their authors, derived from the TPC-H-like tables.

VIEW_SQL is the same view as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pmid, ord, position, last_name, surname_keys, fore_name, initials, affiliation, blocks, orcid, suppkey."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *rest)
    # the first of each place: asked by row_number, Spark would also sort all lines before the shuffle, to drop none
    once = line.withColumn("before", F.lag(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))).where("before IS NULL")
    # texts are taken apart where they stand once, before lines repeat them
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", text.initials(F.col("p_name"), upper=True).alias("initials"), names.surname_keys(F.coalesce("p_brand", F.lit(""))).alias("surname_keys"))
    # nation and region have a fixed size, 25 and 5 rows at every scale
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    spelled = places.select("n_nationkey", "n_name", F.concat("n_name", F.lit("; "), "r_name").alias("both"))
    split = spelled.select("*", text.affiliation_blocks(F.col("n_name")).alias("name_blocks"), text.affiliation_blocks(F.col("both")).alias("both_blocks"))
    number = F.lpad(F.col("s_suppkey").cast("string"), 16, "0")
    dashed = F.concat_ws("-", *[F.substring(number, k, 4) for k in (1, 5, 9, 13)]).alias("dashed")
    supplier = read(spark, sf_dir, "supplier").join(F.broadcast(split), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", dashed, "n_name", "both", "name_blocks", "both_blocks")
    joined = once.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    named = lambda none, both, name: F.when((F.col("l_returnflag") == "N") & (F.col("l_discount") == 0), none).when(F.col("l_linestatus") == "F", F.col(both)).otherwise(F.col(name))
    return joined.select(
        F.col("l_orderkey").cast("string").alias("pmid"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.col("p_brand").alias("last_name"),
        "surname_keys",
        F.col("p_name").alias("fore_name"),
        "initials",
        named(F.lit(""), "both", "n_name").alias("affiliation"),
        F.when(F.col("l_tax") == 0, F.col("dashed")).otherwise("").alias("orcid"),
        F.col("l_suppkey").alias("suppkey"),
        named(F.array().cast("array<string>"), "both_blocks", "name_blocks").alias("blocks"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pmid, ord, print_year, journal, publication_types, doi, source_for_roles, pmcid (authors are counted by with_author_count)."""
    kinds = F.create_map(*map(F.lit, ("F", "Journal Article", "O", "Review", "P", "Preprint")))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("pmid"),
        key.alias("ord"),
        F.year("o_orderdate").alias("print_year"),
        F.col("o_orderpriority").alias("journal"),
        F.array(kinds[F.col("o_orderstatus")]).alias("publication_types"),
        F.concat(F.lit("10.1000/"), F.floor(key / 2).cast("string")).alias("doi"),
        F.when(key % 3 == 0, "pubmed").otherwise("pmc").alias("source_for_roles"),
        F.when(key % 2 == 0, F.concat(F.lit("PMC"), key.cast("string"))).alias("pmcid"),
    )


def author_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pmid of every author, for counting: what authors gives, without the joins that describe them."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").cast("string").alias("pmid"))


def with_author_count(cites: DataFrame, own: DataFrame) -> DataFrame:
    counts = own.groupBy(F.col("pmid").alias("count_pmid")).agg(F.count("*").cast("int").alias("n"))
    return cites.join(counts, F.col("pmid") == F.col("count_pmid"), "left").withColumn("author_count", F.coalesce("n", F.lit(0))).drop("count_pmid", "n")


VIEW_SQL = """
li AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1),
authors AS (
  SELECT l_orderkey::VARCHAR AS pmid, l_orderkey AS ord, l_linenumber AS position, p_brand AS last_name, p_name AS fore_name,
    upper(array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: x[1]), '')) AS initials,
    CASE WHEN l_returnflag = 'N' AND l_discount = 0 THEN '' WHEN l_linestatus = 'F' THEN n_name || '; ' || r_name ELSE n_name END AS affiliation,
    CASE WHEN l_tax = 0 THEN regexp_replace(lpad(l_suppkey::VARCHAR, 16, '0'), '(.{4})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4') ELSE '' END AS orcid,
    l_suppkey AS suppkey
  FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
citations AS (
  SELECT o_orderkey::VARCHAR AS pmid, o_orderkey AS ord, year(o_orderdate)::INT AS print_year, o_orderpriority AS journal,
    CASE o_orderstatus WHEN 'F' THEN 'Journal Article' WHEN 'O' THEN 'Review' WHEN 'P' THEN 'Preprint' END AS kind,
    '10.1000/' || (o_orderkey // 2) AS doi, CASE WHEN o_orderkey % 3 = 0 THEN 'pubmed' ELSE 'pmc' END AS source_for_roles,
    CASE WHEN o_orderkey % 2 = 0 THEN 'PMC' || o_orderkey END AS pmcid,
    coalesce((SELECT count(*) FROM authors a WHERE a.ord = o_orderkey), 0)::INT AS author_count
  FROM orders)"""
