"""Writers: graph tables by edge type, replacement of single edge types, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str) -> None:
    """Partitioned by edge_type, so that reading an axis prunes partitions."""
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(path)


def replace_edge_types(edges: DataFrame, path: str, types: list[str]) -> None:
    """Replace exactly the named edge types by those of ``edges``; the others stay untouched. A named type of which
    ``edges`` has no row is left empty; a row of another type is an error."""
    spark = edges.sparkSession
    odd = edges.where(~F.col("edge_type").isin(types)).select("edge_type").first()
    if odd is not None:
        raise ValueError(f"edge type {odd[0]!r} is not among those to be replaced")
    edges.distinct().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edge_type").parquet(path)
    new = {r[0] for r in edges.select("edge_type").distinct().collect()}  # at most the named types
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for t in set(types) - new:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/edge_type={t}"), True)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upsert_csv(new: DataFrame, path: str, key: list[str]) -> None:
    """Rows of ``new`` replace stored rows of the same key. The stored rows go through the shared folder, not the driver."""
    from taintgraph.session import cut, discard

    spark = new.sparkSession
    try:
        old = spark.read.option("header", True).schema(new.schema).csv(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    out = new if old is None else old.join(new.select(*key), key, "left_anti").select(new.columns).unionByName(new)
    kept = cut(out, "report")
    write_csv(kept, path)
    discard(kept)


def stats_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): sizes per node and edge type."""
    n = nodes.groupBy(F.concat(F.lit("nodes."), "node_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return n.union(edges.groupBy(F.concat(F.lit("edges."), "edge_type").alias("metric")).agg(F.count(F.lit(1)).alias("value")))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table as Markdown text, in the order of its columns. Beyond ``most`` rows it says how many it leaves out."""
    n = df.count()
    rows = df.orderBy(*df.columns).limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    rest = [f"{n - most} of {n} rows are left out.", ""] if n > most else []
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, rows), "", *rest])


def write_fasta(df: DataFrame, path: str, ident: str, sequence: str, width: int = 60) -> None:
    """FASTA text, one record a row, wrapped lines."""
    wrapped = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    df.where(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), wrapped)).write.mode("overwrite").text(path)
