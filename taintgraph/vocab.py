"""Names of node types, edge types and axes. All values here are fixed: stored tables carry them."""

from __future__ import annotations

#: raw node type -> canonical node type (fixed values)
NODE_TYPE = {
    "Example": "Example",
    "Ligand": "Ligand",
    "Scaffold": "Scaffold",
    "ProteinTarget": "Protein",
    "Protein": "Protein",
    "DatasetSource": "DatasetSource",
    "DecoyProtocol": "DecoyProtocol",
    "ChEMBLAssay": "Assay",
    "Assay": "Assay",
    "ChEMBLDocument": "Publication",
    "Publication": "Publication",
}

#: edge types that state that two ligands are one, canonical and raw (fixed values)
LIGAND_IDENTITY = ["ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact", "same_inchikey_as", "same_parent_inchikey_as"]

#: leak axes of split protocols and split audits (fixed values)
AXES = {
    "ligand": ["example_has_ligand", "ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact", "ligand_similar"],
    "scaffold": ["example_has_ligand", "ligand_scaffold"],
    "protein": ["example_has_protein", "protein_in_cluster"],
    "publication": ["example_from_publication"],
    "assay": ["example_from_assay"],
}

#: axes of the residual-leak audit: those above and their union
AXES_WITH_FULL = {**AXES, "full": sorted({t for ts in AXES.values() for t in ts})}

#: axes of the horizon curve (fixed values)
HORIZON_AXES = {
    "ligand_axis": ["example_has_ligand", "ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact", "ligand_similar", "ligand_scaffold"],
    "all": AXES_WITH_FULL["full"],
}

#: raw edge type -> canonical edge type, where they differ (fixed values)
EDGE_TYPE = {
    "example_targets_protein": "example_has_protein",
    "ligand_has_scaffold": "ligand_scaffold",
    "ligand_similar_to_ligand": "ligand_similar",
    "same_inchikey_as": "ligand_exact",
    "same_parent_inchikey_as": "ligand_parent_exact",
    "example_uses_decoy_protocol": "source_decoy_protocol",
}

#: canonical edge types beside those that raw ones become (fixed values)
OWN_EDGE_TYPE = ["example_from_assay", "example_from_publication", "example_from_source", "example_has_ligand", "example_has_timebin", "example_in_trainset", "ligand_fingerprint_exact", "protein_exact", "protein_in_cluster", "time_overlap"]

#: names of the reference layers (fixed values)
REFERENCE_A = {"source": "ChEMBL35", "release": "ChEMBL_35"}
REFERENCE_B = {"source": "BindingDB202605", "release": "BindingDB_2026_05"}

#: accessions of proteins (public format)
ACCESSION = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"

#: columns of the side table (fixed values)
SIDE_TABLE = {
    "example_id": "string", "source": "string", "source_id": "string", "smiles": "string", "smiles_canonical": "string", "inchikey": "string", "uniprot": "string", "target_sequence": "string",
    "target_sequence_saprot": "string", "pdb_id": "string", "chembl_id": "string", "bindingdb_id": "string", "assay_id": "string", "label": "double", "label_kind": "string",
}

#: degree above which a node is flagged as a hub (fixed value)
HUB_DEGREE = 1000
#: hydration sources a side table may name (fixed values)
SIDE_SOURCES = ["chembl", "bindingdb", "litpcba", "dude", "dekois", "pdbbind", "bayesbind", "bigbind"]
