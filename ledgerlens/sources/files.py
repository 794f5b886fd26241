"""CSV inputs with a declared schema, and metric tables as JSON or CSV."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the two CSV inputs, and their separator.
SEPARATOR = ";"
TRANSACTION_SCHEMA = ("step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, "
                      "nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int")
CUSTOMER_SCHEMA = ("ID long, Year_Birth int, Education string, Marital_Status string, Income double, Kidhome int, Teenhome int, "
                   "Dt_Customer string, Recency int, MntWines double, MntFruits double, MntMeatProducts double, MntFishProducts double, "
                   "MntSweetProducts double, MntGoldProds double, NumDealsPurchases int, NumWebPurchases int, NumCatalogPurchases int, "
                   "NumStorePurchases int, NumWebVisitsMonth int, AcceptedCmp3 int, AcceptedCmp4 int, AcceptedCmp5 int, AcceptedCmp1 int, "
                   "AcceptedCmp2 int, Complain int, Z_CostContact int, Z_Revenue int, Response int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, subfolders included."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = store.listFiles(hadoop, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if f.getLen() and not any(part.startswith(("_", ".")) for part in name.removeprefix(hadoop.toString()).split("/")):
            out.append(name)
    return sorted(out)


def _header(spark: SparkSession, file: str, sep: str) -> tuple[str, ...]:
    """The names in a file's first line; compressed files are read as Spark does."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
    first = lines.readLine()
    lines.close()
    return tuple(c.strip() for c in next(csv.reader([(first or "").removeprefix("\ufeff")], delimiter=sep), []))


def raw_csv(spark: SparkSession, path: str, names: list[str], sep: str = SEPARATOR) -> DataFrame:
    """The columns ``names`` of a CSV file or folder as strings. Files with
    another order of columns are read apart, each by its own header; absent
    columns are null and extra ones dropped. Only first lines pass the driver."""
    files = _files(spark, path)
    with ThreadPoolExecutor(max_workers=16) as pool:
        headers = list(pool.map(lambda f: _header(spark, f, sep), files))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f, h in zip(files, headers):
        by_header.setdefault(h, []).append(f)
    out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))
    for header, mine in by_header.items():
        at = {c: i for i, c in reversed(list(enumerate(header)))}  # a name that comes twice is its first column
        schema = ", ".join(f"_c{i} string" for i in range(len(header)))
        part = spark.read.schema(schema).option("sep", sep).option("header", True).csv(mine)
        out = out.unionByName(part.select(*[(F.col(f"_c{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in names]))
    return out


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = SEPARATOR) -> DataFrame:
    """A CSV file or folder with headers, by name and with the types of
    ``schema``. A value that its type can't hold is null; ``malformed_values``
    counts those."""
    want = spark.createDataFrame([], schema).schema
    raw = raw_csv(spark, path, want.names, sep)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want])


def malformed_values(spark: SparkSession, path: str, schema: str, sep: str = SEPARATOR) -> DataFrame:
    """(column, malformed, example) of every column with values that its type
    can't hold; the example is the smallest one. One pass."""
    want = spark.createDataFrame([], schema).schema
    raw = raw_csv(spark, path, want.names, sep)
    bad = F.explode(F.array(*[F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
                                     F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("v"))) for f in want]))
    return (raw.select(bad.alias("_b")).where("_b is not null").groupBy(F.col("_b.column").alias("column"))
            .agg(F.count(F.lit(1)).alias("malformed"), F.min("_b.v").alias("example")))


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return read_csv(spark, path, TRANSACTION_SCHEMA)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    """A2."""
    return read_csv(spark, path, CUSTOMER_SCHEMA)


def read_or_empty(spark: SparkSession, path: str, schema: str, sep: str = SEPARATOR) -> DataFrame:
    """A3: the CSV, or an empty frame of its schema if there is no such path."""
    return read_csv(spark, path, schema, sep) if exists(spark, path) else spark.createDataFrame([], schema)


def row_count(df: DataFrame) -> DataFrame:
    """A4: the number of rows; no column is read."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def write_csv(df: DataFrame, path: str, sep: str = SEPARATOR) -> None:
    df.write.option("sep", sep).option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small metric table as one JSON or CSV file."""
    if kind not in ("json", "csv"):
        raise ValueError(kind)
    one = df.coalesce(1).write.mode("overwrite")
    one.json(path) if kind == "json" else one.option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Columns of a written metric table, by name."""
    if kind == "json":
        return spark.read.schema(schema).json(path)
    return read_csv(spark, path, schema, ",")
