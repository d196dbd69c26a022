"""Readers for the file formats that feed the graph. All take explicit schemas; none infers from a sample of rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.operators.build import label_of_id

ACTIVITY_SCHEMA = "lig_smiles string, uniprot string, active boolean, standard_type string, standard_value double, standard_units string, pchembl_value double, ex_rec_pdb string"


def parse_smi(lines: DataFrame) -> DataFrame:
    """(smiles_input, ext_id_1, ext_id_2) from text lines (value): blank and ``#`` lines are skipped, up to three tokens."""
    t = F.split(F.btrim("value", F.lit(" \t\r\n")), r"\s+")
    return lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(t[0].alias("smiles_input"), F.get(t, F.lit(1)).alias("ext_id_1"), F.get(t, F.lit(2)).alias("ext_id_2"))


def read_smi(spark: SparkSession, path: str, source: str, target: str, label: int, label_type: str, split: str | None = None) -> DataFrame:
    x = parse_smi(spark.read.text(path))
    return x.withColumns({"source": F.lit(source), "target": F.lit(target), "label": F.lit(label).cast("tinyint"), "label_type": F.lit(label_type), "split": F.lit(split).cast("string")})


def read_activities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Known columns by name, whatever their order; malformed values become null. An empty or missing file has no rows."""
    empty = spark.createDataFrame([], ACTIVITY_SCHEMA)
    try:
        head = spark.read.option("header", True).csv(path).columns
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    if not head:
        return empty
    wide = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path, schema=", ".join(f"`{c}` string" for c in head))
    cols = []
    for part in ACTIVITY_SCHEMA.split(", "):
        name, kind = part.split(" ")
        cols.append((F.col(f"`{name}`").try_cast(kind) if name in head else F.lit(None).cast(kind)).alias(name))
    return wide.select(*cols)


def read_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A TSV without header under given names."""
    return spark.read.option("sep", "\t").csv(path, schema=", ".join(f"`{n}` string" for n in names))


def read_wide_tsv(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Named columns of a wide TSV (header name -> new name), as far as it has them; empty cells are null, and lines that
    end before the last wanted column are skipped."""
    head = spark.read.text(path).first()
    names = head[0].split("\t") if head is not None else []
    at = {n: names.index(c) for c, n in wanted.items() if c in names}
    cells = F.split("value", "\t", -1)
    rows = spark.read.text(path)
    if not at:
        return rows.where("false").select()
    rows = rows.where(F.col("value") != head[0]).withColumn("cells", cells).where(F.size("cells") > max(at.values()))
    return rows.select(*[F.nullif(F.col("cells")[i], F.lit("")).alias(n) for n, i in at.items()])


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``."""
    return rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in rows.columns if c != key])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, pq, csv or tsv; anything else is a ValueError."""
    kind = os.path.splitext(path)[1].lower().lstrip(".")
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    raise ValueError(f"unknown manifest format: {path}")


def text_column(df: DataFrame, candidates: tuple[str, ...] = ("smiles_canonical", "canonical_smiles", "smiles")) -> str:
    """The first candidate that the table has, from its schema alone."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")


#: files of the text corpora: file name -> label, label type, split; a null label goes by the row's id (fixed values)
CORPUS_FILES: dict[str, dict[str, tuple[int | None, str | None, str]]] = {
    "DUD-E": {"actives_final.ism": (1, "active", "unknown"), "decoys_final.ism": (0, "decoy", "unknown")},
    "LIT-PCBA": {"actives.smi": (1, "active", "unknown"), "inactives.smi": (0, "inactive", "unknown")},
    "LIT-PCBA-AVE": {
        "active_T.smi": (1, "active", "train"), "active_V.smi": (1, "active", "validation"), "inactive_T.smi": (0, "inactive", "train"), "inactive_V.smi": (0, "inactive", "validation"),
    },
    "DEKOIS": {"active_decoys.smi": (None, None, "unknown")},
}
#: files of the table corpora: split is the folder above the target (fixed values)
TABLE_FILES = {"BayesBind": {"actives.csv": (1, "active"), "random.csv": (0, "random")}}
_OPTIONAL = ["uniprot", "pocket", "standard_type", "standard_value", "standard_units", "pchembl_value", "ex_rec_pdb", "lig_cluster", "rec_cluster", "num_pocket_residues"]
_ROWS = "smiles_input string, ext_id_1 string, ext_id_2 string, source string, target string, label tinyint, label_type string, split string, source_file string"


def _below(spark: SparkSession, root: str, names: list[str]):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}")


def read_corpus(spark: SparkSession, root: str, corpus: str) -> DataFrame:
    """A text corpus below ``root`` in one scan: the target is the file's folder; label, its type and the split by file name,
    or the label by the row's id. Empty files have no rows; an unknown corpus is a KeyError."""
    files = CORPUS_FILES[corpus]
    lines = _below(spark, root, list(files)).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    t = F.split(F.btrim("value", F.lit(" \t\r\n")), r"\s+")
    x = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(
        t[0].alias("smiles_input"), F.get(t, F.lit(1)).alias("ext_id_1"), F.get(t, F.lit(2)).alias("ext_id_2"),
        F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("target"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"),
    )
    by_id = label_of_id(F.coalesce("ext_id_1", F.lit("")))
    label, kind, split = by_id, F.when(by_id == 1, "active").when(by_id == 0, "decoy").otherwise("unknown"), F.lit(None).cast("string")
    for name, (v, k, s) in files.items():
        here = F.col("source_file") == name
        split = F.when(here, s).otherwise(split)
        if v is not None:
            label, kind = F.when(here, v).otherwise(label), F.when(here, k).otherwise(kind)
    x = x.withColumns({"source": F.lit(corpus), "label": label.cast("tinyint"), "label_type": kind, "split": split})
    return x.select(*[c.split(" ")[0] for c in _ROWS.split(", ")])


def read_table_corpus(spark: SparkSession, root: str, corpus: str = "BayesBind") -> DataFrame:
    """A corpus of CSV tables per target below split folders: structures in ``lig_smiles``, optional columns as text. Files
    of a name share their columns; a kind of file that is missing, empty or without structures has no rows."""
    schema = _ROWS + "".join(f", {c} string" for c in _OPTIONAL)
    out = spark.createDataFrame([], schema)
    for name, (v, k) in TABLE_FILES[corpus].items():
        x = _below(spark, root, [name]).option("header", True).option("mode", "PERMISSIVE").csv(root)
        have = {c.lower(): c for c in x.columns}
        smi = have.get("lig_smiles") or have.get("smiles_input")
        if smi is None:
            continue
        path = F.col("_metadata.file_path")
        x = x.select(
            F.col(smi).alias("smiles_input"), F.lit(None).cast("string").alias("ext_id_1"), F.lit(None).cast("string").alias("ext_id_2"), F.lit(corpus).alias("source"),
            F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("target"), F.lit(v).cast("tinyint").alias("label"), F.lit(k).alias("label_type"),
            F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("split"), F.lit(name).alias("source_file"),
            *[(F.col(have[c]) if c in have else F.lit(None)).cast("string").alias(c) for c in _OPTIONAL],
        )
        out = out.unionByName(x.where("smiles_input is not null"))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database table, read in ranges of ``key`` where bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def for_keys(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; no keys give no rows. The planner broadcasts the keys only if they are few."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
