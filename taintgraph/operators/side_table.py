"""The side table: one row per example id with everything that hydration hands out, built from seven sources.

A loader picks columns by name, whatever their case, and fills the fixed schema; what a source lacks is null. Canonical
structures come from the provider; the default one yields null where no chemistry toolkit is installed, and never a
stand-in. A source without its needed columns has no rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.functions.chem import ContentFeatures, ToolkitFeatures
from taintgraph.functions.text import clean_id
from taintgraph.operators import build
from taintgraph.vocab import SIDE_TABLE


def pick(df: DataFrame, *names: str) -> str | None:
    """The table's own spelling of the first of the names that it has, in any letter case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def _text(c: str | None) -> Column:
    return F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string")


def shaped(df: DataFrame, source: str, source_id: Column, **cols: Column) -> DataFrame:
    """Rows in the fixed schema; ids are ``source:source_id``, and rows without one are left out."""
    given = {"source": F.lit(source), "source_id": source_id, "example_id": F.concat(F.lit(f"{source}:"), source_id), **cols}
    x = df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in SIDE_TABLE.items()])
    return x.where("source_id is not null and source_id <> ''")


def from_ligands(ligands: DataFrame, provider: ContentFeatures) -> DataFrame | None:
    smi, key, ident = pick(ligands, "canonical_smiles", "smiles_canonical", "smiles"), pick(ligands, "inchikey", "standard_inchi_key", "inchi_key"), pick(ligands, "chembl_id", "molecule_chembl_id")
    if smi is None or ident is None:
        return None
    return shaped(ligands, "chembl", _text(ident), smiles=_text(smi), smiles_canonical=provider.canonical(_text(smi)), inchikey=_text(key), chembl_id=_text(ident), label=F.lit(0.0))


def from_records(records: DataFrame, provider: ContentFeatures) -> DataFrame | None:
    smi, ident = pick(records, "ligand_smiles", "smiles", "smiles_canonical"), pick(records, "bindingdb_id", "rec_id", "monomer_id")
    if smi is None or ident is None:
        return None
    uni, seq = pick(records, "target_uniprot", "uniprot"), pick(records, "target_sequence", "sequence")
    return shaped(records, "bindingdb", _text(ident), smiles=_text(smi), smiles_canonical=provider.canonical(_text(smi)), uniprot=_text(uni), target_sequence=_text(seq), bindingdb_id=_text(ident), label=F.lit(0.0))


def from_complexes(index: DataFrame, ligands: DataFrame, proteins: DataFrame | None, provider: ContentFeatures) -> DataFrame | None:
    """Measured complexes by PDB id, with the ligand's structure and the protein where they are known."""
    ids = ("pdb_id", "pdb_code", "pdb")
    pdb, lp = pick(index, *ids), pick(ligands, "pdb_id", "pdb_code")
    if pdb is None:
        return None
    label = next((c for c in index.columns if "pk" in c.lower() or "affinity" in c.lower()), None)
    x = index.select(_text(pdb).alias("pdb"), (F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(0.0)) if label else F.lit(0.0)).alias("label"))
    smi = pick(ligands, "smiles", "canonical_smiles")
    if smi and lp:
        x = x.join(ligands.select(_text(lp).alias("pdb"), _text(smi).alias("smi")), "pdb", "left")
    else:
        x = x.withColumn("smi", F.lit(None).cast("string"))
    pp = pick(proteins, "pdb_id", "pdb_code") if proteins is not None else None
    if pp:
        x = x.join(proteins.select(_text(pp).alias("pdb"), _text(pick(proteins, "uniprot", "uniprot_id")).alias("uni"), _text(pick(proteins, "sequence", "target_sequence")).alias("seq")), "pdb", "left")
    else:
        x = x.withColumns({"uni": F.lit(None).cast("string"), "seq": F.lit(None).cast("string")})
    s = F.col("smi")
    return shaped(x, "pdbbind", F.col("pdb"), smiles=s, smiles_canonical=provider.canonical(s), uniprot=F.col("uni"), target_sequence=F.col("seq"), pdb_id=F.col("pdb"), label=F.col("label"), label_kind=F.lit("pact"))


def from_examples(rows: DataFrame, source: str, provider: ContentFeatures) -> DataFrame | None:
    """A benchmark corpus. The most specific id column names a row; where none has a value, the target and a hash of the
    row do, so that equal rows are one. Colons in ids become ``_``: they part source and id."""
    smi = pick(rows, "smiles_canonical", "smiles", "smiles_input")
    if smi is None:
        return None
    ident = next((c for c in (pick(rows, n) for n in ("source_id", "compound_id", "ext_id_1", "ext_id_2", "ligand_id", "smiles_canonical", "inchikey")) if c), None)
    target, label, kind = pick(rows, "target", "protein_id"), pick(rows, "label"), pick(rows, "label_type", "standard_type")
    own = F.concat(F.coalesce(_text(target), F.lit("na")), F.lit("_row"), F.substring(F.md5(F.to_json(F.struct(*rows.columns))), 1, 16))
    sid = F.replace(F.coalesce(F.nullif(_text(ident), F.lit("")), own), F.lit(":"), F.lit("_"))
    binary = F.lower(_text(kind)).isin("active", "decoy", "0", "1", "binary") if kind else F.lit(True)
    return shaped(
        rows, source, sid, smiles=_text(smi), smiles_canonical=provider.canonical(_text(smi)), inchikey=_text(pick(rows, "inchikey", "inchi_key")), uniprot=_text(pick(rows, "uniprot")),
        label=F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(0.0)) if label else F.lit(0.0), label_kind=F.when(F.coalesce(binary, F.lit(False)), "binary").otherwise("pact"),
    )


#: sources in the order in which they win, and how their tables are loaded
LOADERS: dict[str, Callable[..., DataFrame | None]] = {
    "chembl": lambda p, ligands: from_ligands(ligands, p),
    "bindingdb": lambda p, records: from_records(records, p),
    "pdbbind": lambda p, index, ligands, proteins=None: from_complexes(index, ligands, proteins, p),
    **{s: (lambda p, rows, s=s: from_examples(rows, s, p)) for s in ("litpcba", "dude", "dekois", "bayesbind")},
}


def build_side_table(tables: dict[str, dict[str, DataFrame]], provider: ContentFeatures | None = None) -> DataFrame:
    """One row per example id from the sources given as source -> tables of its loader. Of several rows of an id, the one
    of the first source counts, and within it the least by its columns; an unknown source is a KeyError."""
    p = provider or ToolkitFeatures()
    parts = []
    for rank, s in enumerate(LOADERS):
        if s in tables:
            got = LOADERS[s](p, **tables[s])
            if got is not None:
                parts.append(got.withColumn("__rank", F.lit(rank)))
    for s in tables:
        LOADERS[s]  # an unknown name is an error, not an empty source
    if not parts:
        raise ValueError("no source has the columns it needs")
    w = Window.partitionBy(clean_id(F.col("example_id"))).orderBy("__rank", F.struct(*SIDE_TABLE))
    x = reduce(DataFrame.unionByName, parts)
    return x.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*SIDE_TABLE)


def checked(side: DataFrame) -> DataFrame:
    """The table, if nothing is wrong with it."""
    bad = {r["problem"]: r["n"] for r in build.validate_side_table(side).collect() if r["n"]}
    if bad:
        raise ValueError(f"side table: {bad}")
    return side


def counts(side: DataFrame) -> DataFrame:
    """(source, n), and the total."""
    return side.groupBy("source").agg(F.count(F.lit(1)).alias("n")).union(side.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total"), "n"))
