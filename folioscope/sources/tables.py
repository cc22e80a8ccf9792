"""Readers with declared schemas and the boundary projection for external views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# Physical schemas of the stored tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema, so no file is opened to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}.parquet")


def read_ids(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key occurs in ``ids``: the relational form of an IN list of any length."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def external_view(df: DataFrame, allowed: Sequence[str], computed: dict[str, Column] | None = None) -> DataFrame:
    """Only allow-listed columns leave the library; a computed column must be listed as well."""
    extra = computed or {}
    unlisted = sorted(set(extra) - set(allowed))
    if unlisted:
        raise ValueError(f"columns outside the allow-list: {unlisted}")
    wide = df.withColumns(extra)
    missing = sorted(set(allowed) - set(wide.columns))
    if missing:
        raise ValueError(f"allow-listed columns missing: {missing}")
    return wide.select(*allowed)
