"""Contract table over a star schema of order lines (one contract per line item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veedor.schema import CONTRACT_SCHEMA

# Order priority -> modality text; anything else is two blanks.
MODALITIES = {
    "1-URGENT": "Contratación directa",
    "2-HIGH": "Licitación pública",
    "3-MEDIUM": "Contratación Directa (con ofertas)",
    "4-NOT SPECIFIED": "Mínima cuantía",
}


# Declared, so that opening a table starts no job.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _amount() -> Column:
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "N/D")
        .when(F.col("l_discount") >= 0.10, "0")
        .otherwise(F.concat(F.lit("$ "), price))
    )


def _modality() -> Column:
    text = F.lit("  ")
    for code, label in MODALITIES.items():
        text = F.when(F.col("o_orderpriority") == code, label).otherwise(text)
    return text


def _object_text() -> Column:
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand", "o_orderpriority")
    return F.when(F.col("l_linenumber") % 3 == 0, F.col("p_name")).otherwise(full)


def _definitions() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Canonical column -> (expression, tables it needs besides lineitem)."""
    units = F.col("l_quantity").cast("int")
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", units)
    end = F.col("l_shipdate") + F.make_dt_interval(days=units - 3)
    return {
        "id_contrato": (line_id, ()),
        "nombre_entidad": (F.col("c_name"), ("orders", "customer")),
        "nit_entidad": (F.concat(F.lit("NIT"), "o_custkey"), ("orders",)),
        "proveedor": (F.concat(F.lit("Prov "), "s_nationkey"), ("supplier",)),
        "doc_proveedor": (F.concat(F.lit("DOC"), "s_nationkey"), ("supplier",)),
        "modalidad": (_modality(), ("orders",)),
        "tipo_contrato": (F.col("p_type"), ("part",)),
        "departamento": (F.col("r_name"), ("orders", "customer", "nation", "region")),
        "ciudad": (F.col("n_name"), ("orders", "customer", "nation")),
        "fecha_firma": (F.col("o_orderdate"), ("orders",)),
        "fecha_inicio": (F.col("l_shipdate"), ()),
        "fecha_fin": (end, ()),
        "valor_raw": (_amount(), ()),
        "objeto_raw": (_object_text(), ("part", "orders")),
    }


# Fact and its parents in joining order; orders is joined to its own parents first.
_OF_ORDERS = {
    "customer": ("o_custkey", "c_custkey"),
    "nation": ("c_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
}
_OF_LINES = {
    "orders": ("l_orderkey", "o_orderkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
    "part": ("l_partkey", "p_partkey"),
}


def contracts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named canonical columns (all by default), joining only the tables they need.

    Every line item has exactly one parent in each table, so leaving out an unused join
    does not change the rows. Orders meet their customers before the line items, of which there are several times
    as many: these are shuffled for orders and part only. No broadcast hints: Spark decides by table size.
    """
    wanted = columns or tuple(CONTRACT_SCHEMA.names)
    definitions = _definitions()
    needed = {parent for c in wanted for parent in definitions[c][1]}

    def joined(df: DataFrame, parents: dict[str, tuple[str, str]]) -> DataFrame:
        for parent, (left, right) in parents.items():
            if parent in needed:
                side = table(spark, sf_dir, parent)
                side = joined(side, _OF_ORDERS) if parent == "orders" else side
                df = df.join(side, F.col(left) == F.col(right))
        return df

    df = joined(table(spark, sf_dir, "lineitem"), _OF_LINES)
    return df.select(*[definitions[c][0].alias(c) for c in wanted])
