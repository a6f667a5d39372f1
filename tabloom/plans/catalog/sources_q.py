"""Registered source/sink queries (S1–S11) and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir
from ...sources import hashing as H
from ...sources import manifest as M
from ...sources import readers as RD
from ._common import table

ORACLE_DIR = "/root/testdata/sf0.01"


def q_file_hashes_testdata(spark, sf_dir):
    h = H.file_hashes(spark, sf_dir, "sha256", glob="*.parquet")
    return h.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "hash")


def q_row_fingerprint_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return H.row_fingerprints(o).select("o_orderkey", "row_hash")


def q_manifest_orders(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    m = M.manifest(spark, path, RD.read_table(spark, path))
    return m.select("content_hash", "file_bytes", "n_files", "format", "n_rows", "n_cols", "missing_cells", "duplicate_rows")


def q_csv_roundtrip_customer(spark, sf_dir):
    """Write customer as pipe-separated CSV in the shared scratch folder, read it
    back with delimiter and encoding detection (S1–S3, S6)."""
    cust = table(spark, sf_dir, "customer")
    where = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    cust.write.option("header", True).option("sep", "|").csv(where)
    back = RD.read_csv(spark, where)
    return back.select(
        F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_name").cast("string").alias("c_name"),
        F.col("c_nationkey").cast("long").alias("c_nationkey"), F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"),
        F.col("c_mktsegment").cast("string").alias("c_mktsegment"),
    )


QUERIES = {
    "file_hashes_testdata": q_file_hashes_testdata,
    "row_fingerprint_orders": q_row_fingerprint_orders,
    "manifest_orders": q_manifest_orders,
    "csv_roundtrip_customer": q_csv_roundtrip_customer,
}
ORACLE = {
    "file_hashes_testdata": f"SELECT parse_filename(filename) AS file_name, CAST(size AS BIGINT) AS length, sha256(content) AS hash "
                            f"FROM read_blob('{ORACLE_DIR}/*.parquet')",
    "row_fingerprint_orders": "SELECT o_orderkey, sha256(array_to_string([coalesce(length(t) || ':' || t, '~') FOR t IN [CAST(o_orderkey AS VARCHAR), "
                              "CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), "
                              "o_orderpriority]], '|')) AS row_hash FROM orders",
    "manifest_orders": f"""SELECT (SELECT sha256(content) FROM read_blob('{ORACLE_DIR}/orders.parquet')) AS content_hash, (SELECT CAST(size AS BIGINT) FROM read_blob('{ORACLE_DIR}/orders.parquet')) AS file_bytes, CAST(1 AS BIGINT) AS n_files,
  'parquet' AS format, CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_cols, CAST(0 AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS BIGINT) AS duplicate_rows FROM orders""",
    "csv_roundtrip_customer": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
}


def q_csv_multiline_documents(spark, sf_dir):
    """Documents as one semicolon-separated CSV folder, texts with their line breaks, quotes and semicolons, read
    back with detection by many tasks (S1, S2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('line "one"; '), F.lower("lang"), F.lit("\nand, two\n\n"), F.regexp_replace("text", "[\r]", " ")).alias("note"), "source")
    where = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    docs.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(where)
    back = RD.read_csv(spark, where)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("note").cast("binary")).alias("note_md5"), F.col("source").cast("string").alias("source"))


def q_file_hashes_streamed(spark, sf_dir):
    """The same hashes as ``file_hashes_testdata``, every file read in splits as a stream."""
    h = H.file_hashes(spark, sf_dir, "sha256", glob="*.parquet", stream_above=0)
    return h.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "hash")


QUERIES["csv_multiline_documents"] = q_csv_multiline_documents
QUERIES["file_hashes_streamed"] = q_file_hashes_streamed
ORACLE["csv_multiline_documents"] = """SELECT doc_id, md5('line "one"; ' || lower(lang) || chr(10) || 'and, two' || chr(10) || chr(10) || regexp_replace(text, '[\r]', ' ', 'g')) AS note_md5, source
FROM documents"""
ORACLE["file_hashes_streamed"] = ORACLE["file_hashes_testdata"]
