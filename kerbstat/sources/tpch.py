"""Citations derived from TPC-H shaped tables, one per line item.

Nulls and dirty text are put in by modulus of a row number ``k``, so that every cleaning rule
has work to do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbstat.schema import CITATION_SCHEMA
from kerbstat.session import spread

HELPERS = {
    "k": "l_orderkey * 31 + l_partkey * 7 + l_suppkey * 3 + l_linenumber",
    "vc": "least(l_partkey % 50, l_suppkey % 50)",
}


def _pick(values: str, index: str) -> str:
    return f"split_part('{values}', ',', CAST(1 + {index} AS INT))"


COLUMNS = {
    "summons_number": """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
        CAST(round(l_extendedprice * 100) AS BIGINT))""",
    "source_dataset": "'lineitem'",
    "issue_date": "CASE WHEN k % 97 <> 0 THEN CAST(l_shipdate AS DATE) END",
    "violation_time": """CASE
        WHEN k % 23 = 0 THEN NULL
        WHEN k % 29 = 0 THEN concat(' ', lpad(1 + k % 12, 2, '0'), '32a')
        WHEN k % 31 = 0 THEN '1332P'
        WHEN k % 37 = 0 THEN '1432'
        WHEN k % 41 = 0 THEN 'abc'
        WHEN k % 89 = 0 THEN '0032P'
        ELSE concat(lpad(1 + k % 12, 2, '0'), lpad(k % 60, 2, '0'), CASE WHEN k % 5 < 2 THEN 'A' ELSE 'P' END) END""",
    "violation_code": "CASE WHEN k % 101 = 0 THEN NULL WHEN k % 9973 = 0 THEN '99' ELSE CAST(vc AS STRING) END",
    "violation_desc": "CASE WHEN k % 53 <> 0 THEN concat('CODE ', vc) END",
    "issuing_agency": f"CASE WHEN k % 43 <> 0 THEN {_pick('P, t ,S,V,p', 'k % 5')} END",
    "county": f"CASE WHEN k % 67 <> 0 THEN {_pick('NY,MN,K,BK,Q,qn ,BX,R,ST,XX', 'l_suppkey % 10')} END",
    "precinct": "CASE WHEN k % 47 <> 0 THEN CAST(l_suppkey % 77 + 1 AS STRING) END",
    "street_name": f"""CASE WHEN k % 59 = 0 THEN NULL WHEN k % 61 = 0 THEN '   ' ELSE concat('W ', l_suppkey % 13,
        {_pick(' AVE, St,  AVENUE , STREET, BROADWAY, RD, STATE', 'l_partkey % 7')}) END""",
    "intersecting_street": "p_brand",
    "latitude": "CASE WHEN k % 7 <> 0 THEN 40.5002D + (l_partkey % 50) * 0.001D END",
    "longitude": "CASE WHEN k % 7 <> 0 THEN -74.2002D + (l_suppkey % 50) * 0.001D END",
    "fine_amount": "CASE WHEN k % 19 <> 0 THEN CAST(35 + (vc % 9) * 10 + k % 4 AS DECIMAL(10,2)) END",
    "plate_id": "concat('P', l_orderkey)",
    "registration_state": _pick("NY,NJ,PA,CT", "k % 4"),
    "plate_type": f"CASE WHEN k % 71 <> 0 THEN {_pick('PAS,COM,omt ,OMS,SRF,MED,PHS,APP', 'k % 8')} END",
    "soda_row_id": "concat('row-', k)",
    "soda_created_at": "o_orderdate",
    "soda_updated_at": "l_shipdate",
    "ingested_at": "l_shipdate",
}


def citations_from_tpch(
    spark: SparkSession, path: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """Citation table over ``path``; only the parents that the wanted columns need are joined."""
    wanted = list(columns or COLUMNS)
    rows = spread(spark.read.parquet(f"{path}/lineitem.parquet"), "l_orderkey", "l_linenumber")
    if "soda_created_at" in wanted:
        orders = spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", "o_orderdate")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "intersecting_street" in wanted:
        part = spark.read.parquet(f"{path}/part.parquet").select("p_partkey", "p_brand")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.selectExpr("*", *[f"{value} AS {name}" for name, value in HELPERS.items()]).selectExpr(
        *[f"CAST({COLUMNS[c]} AS {CITATION_SCHEMA[c].dataType.simpleString()}) AS {c}" for c in wanted]
    )
