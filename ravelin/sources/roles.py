"""Record tables S1, S2 and S3 and their truth, made from whole tables of the test schema.

Each part is one record. Its number decides its source (so the three sources together are the whole table), its type a
legal ending, its brand a country and a street. Two records of different sources are the same business where name, brand
and type are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same definition for Spark and for DuckDB.
RECORDS_SQL = """
SELECT concat('S', CAST(p_partkey % 3 + 1 AS VARCHAR(9)), '-', lpad(CAST(p_partkey AS VARCHAR(19)), 9, '0')) AS entity_id,
  concat(p_name, CASE p_type WHEN 'PROMO' THEN ' Pvt. Ltd.' WHEN 'STANDARD' THEN ' & Co' WHEN 'LARGE' THEN ' Inc.' WHEN 'SMALL' THEN ' L.L.C.'
    WHEN 'MEDIUM' THEN ' CORP' ELSE '' END) AS business_name,
  CASE WHEN p_size = 50 THEN '' ELSE concat('H.No ', CAST(p_size AS VARCHAR(9)), '/', CAST(p_size % 7 AS VARCHAR(9)), ', ', replace(p_brand, '#', ' '),
    CASE WHEN p_size % 2 = 0 THEN ' Rd, ' ELSE ' Road. ' END, CAST(10000 + p_size % 10 * 100 + length(p_brand) * 10 AS VARCHAR(9))) END AS business_address,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8') THEN 'USA'
    WHEN p_brand IN ('Brand#9', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13') THEN 'Bharat' ELSE 'France' END AS country
FROM part
"""

TRUTH_SQL = """
SELECT a.sid AS s1_id, b.sid AS target_id FROM (SELECT concat('S1-', lpad(CAST(p_partkey AS VARCHAR(19)), 9, '0')) AS sid, * FROM part WHERE p_partkey % 3 = 0) a
JOIN (SELECT concat('S', CAST(p_partkey % 3 + 1 AS VARCHAR(9)), '-', lpad(CAST(p_partkey AS VARCHAR(19)), 9, '0')) AS sid, * FROM part WHERE p_partkey % 3 <> 0) b
ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What is the same in the records of one business, and nowhere else; null where no other record can have it.
BUSINESS = "CASE WHEN p_name IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL THEN struct(p_name, p_brand, p_type) END AS business"


def records(spark: SparkSession, sf_dir: str, business: bool = False) -> DataFrame:
    more = f", {BUSINESS} " if business else ""
    return spark.sql(RECORDS_SQL.replace("FROM part", more + "FROM {part}"), part=table(spark, sf_dir, "part"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, target_id)."""
    return spark.sql(TRUTH_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(S1, S2 and S3)."""
    first = F.col("entity_id").startswith("S1-")
    return rows.filter(first), rows.filter(~first)
