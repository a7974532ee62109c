"""Scans and sinks: Parquet, CSV and pipe-delimited tables with explicit schemas, domain files, views."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.ordered import number_within

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; the schema is given, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tbl(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Pipe-delimited rows without header; the field after the trailing separator is ignored."""
    return spark.read.schema(schema).option("sep", "|").option("mode", "PERMISSIVE").csv(path).drop(*drop)


def read_keyed(df: DataFrame, key: str, fk: str, attrs: list[str], ratio: float = 1.0) -> DataFrame:
    """key, attrs, fk of a child table; raises if the key repeats; with `ratio`, the groups whose foreign keys
    come first, that share of them rounded down. Keys of any type; rows without a foreign key come first."""
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    out = df.select(key, *attrs, fk)
    if ratio >= 1:
        return out
    groups = out.select(fk).distinct()
    first = number_within(groups, [], [F.asc_nulls_first(fk)], "_at").filter(F.col("_at") < int(ratio * groups.count())).select(F.col(fk).alias("_fk"))
    return out.join(first, F.col(fk).eqNullSafe(F.col("_fk")), "left_semi")


def read_pair(spark: SparkSession, folder: str, parent: str, child: str, schemas: dict[str, str]) -> tuple[DataFrame, DataFrame, dict[str, int], dict[str, int]]:
    """A parent and a child table and their domains, by name: {name}.csv beside {name}_domain.json."""
    frames = [read_csv(spark, f"{folder}/{n}.csv", schemas[n]) for n in (parent, child)]
    domains = [read_domain(f"{folder}/{n}_domain.json", None) for n in (parent, child)]
    return *frames, *domains


def split_denormalised(df: DataFrame, parent_key: str, parent_attrs: list[str], child_attrs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, children and group sizes of one table that repeats the parent on every child row."""
    drop = [c for c in df.columns if c.startswith("group_type")]
    df = df.drop(*drop)
    parents = df.groupBy(parent_key).agg(*[F.first(a).alias(a) for a in parent_attrs], F.count(F.lit(1)).alias("size"))
    return parents.select(parent_key, *parent_attrs), df.select(*child_attrs, parent_key), parents.select(parent_key, "size")


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case names; columns with "key" in their name become long."""
    def one(c: str) -> Column:
        return (F.col(f"`{c}`").cast("long") if "key" in c.lower() else F.col(f"`{c}`")).alias(c.lower())

    return df.select(*[one(c) for c in df.columns])


def read_domain(path: str, columns: list[str] | None) -> dict[str, int]:
    """attr -> size from a domain file {attr: {"size": n}}, in the order of columns, or of the file without."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    columns = list(found) if columns is None else columns
    missing = [c for c in columns if c not in found]
    if missing:
        raise ValueError(f"{path} has no domain for {missing}")
    return {c: int(found[c]["size"]) for c in columns}


def write_domain(path: str, domain: dict[str, int], continuous: set[str] = frozenset()) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({a: {"size": n, "type": "continuous" if a in continuous else "discrete"} for a, n in domain.items()}, f)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Replace a table of a database; rows go in batches from the executors."""
    df.write.mode("overwrite").option("batchsize", 10_000).jdbc(url, name, properties=properties)


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the Parquet tables: load, or replace, a database."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def run_sql_file(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """The result of the query in a text file (in any store that Spark reads), with `out` written there as
    Parquet and read again. Lines after -- and a final ; are left out."""
    lines = [r.value.split("--")[0] for r in spark.read.text(path, wholetext=False).collect()]  # a query's text
    found = run_sql(spark, "\n".join(lines).strip().rstrip(";"))
    if out is None:
        return found
    found.write.mode("overwrite").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def row_counts(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """(table_name, n) by table."""
    parts = [table(spark, folder, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "n")


def error_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbers behind "error:" in log files."""
    found = F.regexp_extract("value", r"error:\s*([-+0-9.eE]+)", 1)
    return spark.read.text(path).select(found.try_cast("double").alias("error")).filter("error is not null")
