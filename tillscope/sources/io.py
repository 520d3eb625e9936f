"""Tables in and out: scans with declared schemas, replace, append and staged replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema, so no job is spent on inferring it."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def materialize(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Full refresh of a stored table; returns the stored rows."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(
    df: DataFrame, table: str, path: str, key: str, buckets: int
) -> DataFrame:
    """Full refresh of a catalog table bucketed and sorted by a key.

    Tables bucketed alike join and group by that key without a shuffle; worth it for facts that
    several pipelines read.
    """
    (
        df.write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_from_self(df: DataFrame, base: str, version: int) -> DataFrame:
    """Replace a table by a query that reads it: the new version goes to its own folder.

    Spark cannot overwrite a path it reads, so versions live side by side and readers move to the
    new one once it is complete.
    """
    return materialize(df, f"{base}/v{version}")


def declared(fields: list[tuple[str, str, bool]]) -> T.StructType:
    """StructType from (name, type, nullable); varchar(n) lengths are kept as metadata."""
    out = T.StructType()
    for name, kind, nullable in fields:
        meta = {}
        if kind.startswith("varchar("):
            meta["max_length"] = int(kind[8:-1])
            kind = "string"
        out.add(T.StructField(name, T._parse_datatype_string(kind), nullable, meta))
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema; a NULL in a required column or an over-long text fails the job.

    The checks are expressions of the same pass, so they cost no extra scan.
    """
    cols = []
    for field in schema:
        col = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            col = F.when(col.isNotNull(), col).otherwise(
                F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType)
            )
        limit = field.metadata.get("max_length")
        if limit:
            col = F.when(F.length(col) > limit, F.raise_error(
                F.lit(f"{field.name} is longer than {limit}")).cast(field.dataType)
            ).otherwise(col)
        cols.append(col.alias(field.name))
    return df.select(*cols)
