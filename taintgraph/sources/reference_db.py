"""Loaders of a reference database of measured activities, over any way to read its tables.

``read`` gives a table by name: :func:`jdbc` for a database, ``spark.read.parquet`` for an export. Columns are named by the
public schema of the database; projections and filters reach the source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.sources.readers import first_seen, for_keys, read_jdbc, read_wide_tsv

Read = Callable[[str], DataFrame]

#: columns of the wide binding table and the names they get (fixed values)
BINDING_COLUMNS = {
    "Ligand SMILES": "ligand_smiles", "Ligand InChI Key": "ligand_inchikey", "Target Name": "target_name", "Ki (nM)": "ki_nM", "IC50 (nM)": "ic50_nM", "Kd (nM)": "kd_nM", "EC50 (nM)": "ec50_nM",
    "Article DOI": "article_doi", "PMID": "pmid", "PubChem AID": "pubchem_aid", "PubChem CID": "pubchem_cid", "ChEMBL ID of Ligand": "chembl_id_ligand", "ZINC ID of Ligand": "zinc_id_ligand",
    "UniProt (SwissProt) Primary ID of Target Chain 1": "uniprot_swissprot_id", "UniProt (SwissProt) Recommended Name of Target Chain 1": "uniprot_name",
    "Target Source Organism According to Curator or DataSource": "target_organism", "BindingDB Reactant_set_id": "bindingdb_record_id",
}


def jdbc(spark: SparkSession, url: str, keys: dict[str, tuple[str, int, int]] | None = None, parts: int = 16) -> Read:
    """Tables of a database; those in ``keys`` (table -> key, lower, upper) are read in ranges side by side."""

    def read(name: str) -> DataFrame:
        key = (keys or {}).get(name)
        return read_jdbc(spark, url, name, key[0], key[1:], parts) if key else read_jdbc(spark, url, name)

    return read


def ligands(read: Read) -> DataFrame:
    """One row per molecule, with its structure where there is one."""
    m, s = read("molecule_dictionary"), read("compound_structures").select("molregno", "canonical_smiles", "standard_inchi_key")
    return m.select("molregno", F.col("chembl_id").alias("molecule_chembl_id"), "pref_name", "max_phase").join(s, "molregno", "left")


def targets(read: Read) -> DataFrame:
    return read("target_dictionary").select("tid", F.col("chembl_id").alias("target_chembl_id"), "pref_name", "target_type", "organism")


def target_sequences(read: Read) -> DataFrame:
    """One row per target and protein chain with a known sequence."""
    t = read("target_dictionary").select("tid", F.col("chembl_id").alias("target_chembl_id"))
    c = read("component_sequences").where("sequence is not null and component_type = 'PROTEIN'").select("component_id", "accession", "sequence", "component_type", "organism", "description")
    return t.join(read("target_components").select("tid", "component_id"), "tid").join(c, "component_id").drop("component_id")


def documents(read: Read) -> DataFrame:
    return read("docs").select("doc_id", F.col("chembl_id").alias("document_chembl_id"), "pubmed_id", "doi", "year", "journal", "title")


def assays(read: Read) -> DataFrame:
    return read("assays").select("assay_id", F.col("chembl_id").alias("assay_chembl_id"), "assay_type", "description", "doc_id", "tid")


def activities_of(read: Read, molecules: DataFrame) -> DataFrame:
    """Activities of the wanted molecules (molregno); none wanted, none read."""
    a = read("activities").select("activity_id", "molregno", "assay_id", "standard_type", "standard_relation", "standard_value", "standard_units", "pchembl_value", "doc_id")
    return for_keys(a, molecules.where("molregno is not null"), "molregno")


def binding_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, ligands) of a wide binding table: the known columns that it has, and per ligand key the first row of the file."""
    rec = read_wide_tsv(spark, path, BINDING_COLUMNS)
    have = [c for c in ("ligand_smiles", "chembl_id_ligand", "zinc_id_ligand", "pubchem_cid") if c in rec.columns]
    if "ligand_inchikey" not in rec.columns:
        return rec, spark.createDataFrame([], "ligand_inchikey string")
    keyed = rec.where("ligand_inchikey is not null").select("ligand_inchikey", *have, F.monotonically_increasing_id().alias("at"))
    return rec, first_seen(keyed, "ligand_inchikey", "at").drop("at")
