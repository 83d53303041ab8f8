"""Genomic tables derived from the driver's tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.session import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters as bases and as Phred characters; J, Q and X stand for the unknown base.
AS_BASES = "ACGTACGTANGTACGTNCGTACGNAC"
AS_QUALITY = "0123456789:;<=>?@ABCDEFGHI"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_idx, id, seq, qual: the letters of each document."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("read_idx"), F.concat(F.lit("read_"), F.col("doc_id").cast("string")).alias("id"), letters.alias("letters"))
    return docs.select("read_idx", "id", F.translate("letters", LETTERS, AS_BASES).alias("seq"), F.translate("letters", LETTERS, AS_QUALITY).alias("qual"))


READS = f"""v_reads AS (
    SELECT doc_id AS read_idx, 'read_' || doc_id AS id, translate(letters, '{LETTERS}', '{AS_BASES}') AS seq, translate(letters, '{LETTERS}', '{AS_QUALITY}') AS qual
    FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters FROM documents))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, feature_id, start, end, strand, type, tag, product: one interval for each numbered order line."""
    kept = ["l_suppkey", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag"]
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in kept])
    start = (F.col("l_partkey") * 10).alias("start")
    return line.select(
        F.col("l_suppkey").alias("contig"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature_id"),
        start,
        (F.col("l_partkey") * 10 + (F.col("l_quantity") * 3).cast("long")).alias("end"),
        F.when(F.col("l_linestatus") == "F", "-").otherwise("+").alias("strand"),
        F.when(F.col("l_returnflag") == "R", "tRNA").when(F.col("l_returnflag") == "A", "gene").otherwise("CDS").alias("type"),
        F.concat(F.lit("LT_"), F.col("l_orderkey").cast("string")).alias("tag"),
        F.concat(F.lit("protein "), F.col("l_partkey").cast("string")).alias("product"),
    )


FEATURES = """v_features AS (
    SELECT l_suppkey AS contig, l_orderkey * 10 + l_linenumber AS feature_id, l_partkey * 10 AS start, l_partkey * 10 + (l_quantity * 3)::BIGINT AS "end",
           CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
           CASE l_returnflag WHEN 'R' THEN 'tRNA' WHEN 'A' THEN 'gene' ELSE 'CDS' END AS type, 'LT_' || l_orderkey AS tag, 'protein ' || l_partkey AS product
    FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag
          FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, sample, present over the full grid: brand bought in quantity by customer.

    Parts, orders and purchases grow with the data, so their joins are by merging: no estimate makes the driver hold one.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene")).hint("merge")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample")).hint("merge")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey")
    bought = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey).select("gene", "sample").distinct().withColumn("present", F.lit(True))
    genes = part.select("gene").distinct()
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")).crossJoin(F.broadcast(genes))
    return grid.join(bought.hint("merge"), ["gene", "sample"], "left").select("gene", "sample", F.coalesce("present", F.lit(False)).alias("present"))


PRESENCE = """v_pa AS (
    SELECT g.gene, c.c_custkey AS sample, coalesce(b.present, false) AS present
    FROM (SELECT DISTINCT p_brand AS gene FROM part) g CROSS JOIN customer c
    LEFT JOIN (SELECT DISTINCT p_brand AS gene, o_custkey AS sample, true AS present
               FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45) b
      ON b.gene = g.gene AND b.sample = c.c_custkey)"""


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, is_case, value, stratum of each customer."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("stratum"))
    cust = table(spark, sf_dir, "customer")
    return cust.join(F.broadcast(place), cust.c_nationkey == place.n_nationkey).select(
        F.col("c_custkey").alias("sample"), (F.col("c_mktsegment") == "BUILDING").alias("is_case"), F.col("c_acctbal").alias("value"), "stratum"
    )


TRAITS = """v_trait AS (
    SELECT c_custkey AS sample, c_mktsegment = 'BUILDING' AS is_case, c_acctbal AS value, r_name AS stratum
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, col, base: a row for each nation, a column for each part, with substitutions and gaps."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), "p_size")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq_idx"))
    cell = part.crossJoin(F.broadcast(nation))
    change = F.when((F.col("seq_idx") * 7919 + F.col("col") * 104729) % 97 < F.col("seq_idx") % 7 + 2, 1 + (F.col("seq_idx") + F.col("col")) % 3).otherwise(0)
    letter = F.substring(F.lit("ACGT"), ((F.col("p_size") + F.col("col") * 31 + change) % 4 + 1).cast("int"), F.lit(1))
    gap = (F.col("seq_idx") * 13 + F.col("col") * 29) % 211 == 0
    return cell.select("seq_idx", "col", F.when(gap, "-").otherwise(letter).alias("base"))


ALIGNMENT = """v_aln AS (
    SELECT n_nationkey::BIGINT AS seq_idx, p_partkey AS col,
           CASE WHEN (n_nationkey::BIGINT * 13 + p_partkey * 29) % 211 = 0 THEN '-' ELSE substr('ACGT', ((p_size + p_partkey * 31 +
           CASE WHEN (n_nationkey::BIGINT * 7919 + p_partkey * 104729) % 97 < n_nationkey % 7 + 2 THEN 1 + (n_nationkey::BIGINT + p_partkey) % 3 ELSE 0 END) % 4 + 1)::INT, 1) END AS base
    FROM part CROSS JOIN nation)"""


def with_views(sql: str, *views: str) -> str:
    """``sql`` after a WITH clause of the views; ``sql`` may start with further named queries after ``WITH``."""
    body = sql.strip()
    head = "WITH " + ",\n".join(views)
    return f"{head},\n{body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"{head}\n{body}"
