"""CSV export: tolerant read, typed Parquet copy, result sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veedor.functions.parsing import parse_export_date
from veedor.runtime import delete_path, shuffles_dropped
from veedor.sources.records import read_records
from veedor.schema import API_COLUMNS, DATE_COLUMNS, EXPORT_COLUMNS

REJECT = "_corrupt_record"


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    quote: str = '"',
    encoding: str = "UTF-8",
    header: bool = True,
    columns: list[str] | None = None,
    multiline: bool = True,
    header_count: int = 1,
    column_header: int = 1,
) -> DataFrame:
    """All columns as text plus ``_corrupt_record`` for rows with too few or too many fields.

    With ``multiline`` line breaks inside quotes belong to the field; large files are split all
    the same. Lines of a record whose quote never closes are rejected one by one, their columns NULL.
    Switch it off for exports known to hold none: that saves a pass. ``header_count``
    lines at the head of each file are no rows, and the ``column_header``-th of them (from 1)
    names the columns; both need ``header`` and heading lines without line breaks.
    """
    options = {
        "sep": sep,
        "quote": quote,
        "escape": quote,
        "maxCharsPerColumn": "-1",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": REJECT,
    }
    plain = (header_count, column_header) == (1, 1) or not header
    if columns is None:
        columns = _heading(spark, path, options, encoding, header, column_header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, REJECT]])
    splittable = encoding.upper() in ("UTF-8", "ISO-8859-1", "US-ASCII") and len(quote) == len(sep) == 1
    if splittable and (multiline or not plain):
        skipped = header_count if header else 0
        rows = read_records(spark, path, sep, quote, encoding).where(F.coalesce("number", F.lit(skipped)) >= skipped)
        read = rows.select("record", "broken", F.from_csv("record", _ddl(schema), options).alias("r"))
        fields = [F.when(~F.col("broken"), F.col(f"r.{_name(c)}")).alias(c) for c in columns]
        return read.select(*fields, F.when(F.col("broken"), F.col("record")).otherwise(F.col(f"r.{REJECT}")).alias(REJECT))
    reader = spark.read.options(**options, header=str(header).lower(), encoding=encoding, multiLine=str(multiline).lower())
    return reader.schema(schema).csv(path)


def _name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{_name(f.name)} STRING" for f in schema)


def _heading(spark: SparkSession, path, options: dict, encoding: str, header: bool, line: int) -> list[str]:
    """Column names from a file's heading, or numbered ones."""
    if line == 1:
        return spark.read.options(**options, header=str(header).lower(), encoding=encoding).csv(path).columns
    # The first lines of one file: all are read by the same heading.
    first = min(spark.read.text(path).inputFiles())
    begin = spark.read.option("lineSep", "\n").text(first).where(F.col("_metadata.file_block_start") == 0)
    value = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    lines = begin.select(F.regexp_replace(value, "\r$", "").alias("line")).limit(line).collect()
    if len(lines) < line:
        raise ValueError(f"no line {line} in {first}")
    text = lines[-1].line
    named = spark.createDataFrame([(text,)], "value string")
    width = named.select(F.size(F.split("value", re.escape(options["sep"])))).first()[0]
    fields = ", ".join(f"c{k} STRING" for k in range(width))
    found = named.select(F.from_csv("value", fields, {k: v for k, v in options.items() if k != "columnNameOfCorruptRecord"}).alias("r")).first()[0]
    return [x for x in found if x is not None]


def canonical(
    df: DataFrame, names: dict[str, str] = EXPORT_COLUMNS, date_order: str = "mdy"
) -> DataFrame:
    """Rename to canonical names, parse the three dates, keep every other column as it is.

    A canonical column the input lacks becomes NULL.
    """
    present = set(df.columns)
    mapped: list[Column] = []
    for raw, name in names.items():
        text = F.col(f"`{raw}`") if raw in present else F.lit(None).cast("string")
        value = parse_export_date(text, date_order) if name in DATE_COLUMNS else text.cast("string")
        mapped.append(value.alias(name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in names and c != REJECT]
    return df.select(*mapped, *extra)


def land_export(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    date_order: str = "mdy",
    consume: bool = False,
    **read_options,
) -> tuple[DataFrame, DataFrame]:
    """Copy an export to ``target`` and return (contracts, rejected records).

    Every column is landed first: which rows are malformed must not depend on the columns
    a later query happens to read. What is landed is copied some files at a time, so that only their
    shuffle lies on disk. With ``consume`` the source is deleted when it is landed, landed files when they are copied.
    """
    landing = f"{target}/landing"
    with shuffles_dropped(spark):
        read_text_table(spark, source, **read_options).write.mode("overwrite").option("compression", "zstd").parquet(landing)
    landed = spark.read.parquet(landing)
    rejected = landed.where(F.col(REJECT).isNotNull())
    if consume:
        rejected.write.mode("overwrite").parquet(f"{target}/rejected")
        rejected = spark.read.schema(landed.schema).parquet(f"{target}/rejected")
        for path in [source] if isinstance(source, str) else source:
            delete_path(spark, path)
    for number, files in enumerate(_portions(spark, landing)):
        rows = spark.read.schema(landed.schema).parquet(*files).where(F.col(REJECT).isNull())
        write_contracts(canonical(rows, date_order=date_order), f"{target}/contracts", "append" if number else "overwrite")
        if consume:
            for file in files:
                delete_path(spark, file)
    return read_contracts(spark, f"{target}/contracts"), rejected


def _portions(spark: SparkSession, folder: str) -> list[list[str]]:
    """The data files of a folder in at most some ``PORTIONS`` groups of about equal size, of ``PORTION_BYTES`` at least."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted((s.getPath().toString(), s.getLen()) for s in found if not s.getPath().getName().startswith(("_", ".")))
    most = max(PORTION_BYTES, sum(size for _, size in files) // PORTIONS)
    groups, held = [[]], 0
    for name, size in files:
        if groups[-1] and held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


#: Into how many portions, and of what size at least, a landed export is cut while it is copied.
PORTIONS, PORTION_BYTES = 8, 64 << 20
#: Folder of contracts whose department is the empty text: an empty partition value reads as NULL.
EMPTY = "(vacío)"


def write_contracts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by start year and department.

    The rebalance hint splits a hot (year, department) over several tasks and files and
    merges small ones.
    """
    department = F.when(F.col("departamento") == "", F.lit(EMPTY)).otherwise(F.col("departamento"))
    keyed = df.withColumns({"anio_inicio": F.year("fecha_inicio"), "departamento": department})
    with shuffles_dropped(df.sparkSession):
        keyed.hint("rebalance", "anio_inicio", "departamento").write.mode(mode).option("compression", "zstd").partitionBy(
            "anio_inicio", "departamento"
        ).parquet(path)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Read the typed copy; partition values stay text (no ``05`` -> 5)."""
    found = spark.read.parquet(path).schema
    fixed = {"departamento": T.StringType(), "anio_inicio": T.IntegerType()}
    schema = T.StructType(
        [T.StructField(f.name, fixed.get(f.name, f.dataType)) for f in found.fields]
    )
    department = F.when(F.col("departamento") == EMPTY, F.lit("")).otherwise(F.col("departamento"))
    return spark.read.schema(schema).parquet(path).withColumn("departamento", department)


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed JSON pages of the API, values as text: one array per file, or one object per
    line with ``lines`` (then large files are split).

    Offset paging can deliver a row twice, so one row per id is kept: the greatest one,
    whatever the file order. Rows without id are only merged when equal in full.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in API_COLUMNS])
    rows = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    rest = [c for c in rows.columns if c != "id_contrato"]
    no_id = F.when(F.col("id_contrato").isNull(), F.struct(*rest)).alias("_no_id")
    merged = rows.groupBy("id_contrato", no_id).agg(F.max(F.struct(*rest)).alias("_row"))
    return canonical(merged.select("id_contrato", "_row.*"), API_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    """Result export with a header. Spark writes UTF-8 without a byte-order mark."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def save_run(df: DataFrame, path: str, **parameters: object) -> None:
    """Append a ranked result, partitioned by the parameters of the run."""
    tagged = df.withColumns({k: F.lit(v) for k, v in parameters.items()})
    tagged.write.mode("append").partitionBy(*parameters).parquet(path)
