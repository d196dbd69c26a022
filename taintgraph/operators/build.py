"""Building the graph: ids, node and edge emission, reference maps, provenance, consolidation, side table, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.functions.chem import letter_count
from taintgraph.functions.text import accession, clean_id, strip
from taintgraph.operators import graph
from taintgraph.session import cut
from taintgraph.vocab import ACCESSION, EDGE_TYPE, NODE_TYPE, OWN_EDGE_TYPE, SIDE_SOURCES, SIDE_TABLE


# -- ids -------------------------------------------------------------------------------------------------------------
def ligand_id(canonical: Column) -> Column:
    return F.concat(F.lit("lig:"), F.md5(canonical))


def scaffold_id(scaffold: Column) -> Column:
    """The empty scaffold is a node of its own."""
    return F.concat(F.lit("sca:"), F.md5(F.coalesce(scaffold, F.lit(""))))


def rank_in_order(rows: DataFrame, keys: list[str], order_by: list[str], name: str) -> DataFrame:
    """Adds the position (from 0) of each row within its keys, by the declared order.

    Rows are laid out by ranges of (keys, order), so a hot key is spread over many tasks; positions are those within a
    range plus the rows of the key in earlier ranges."""
    x = cut(rows.repartitionByRange(*keys, *order_by).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    n = x.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    n = n.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r"), "__before")
    here = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order_by)) - 1
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return x.withColumn("__here", here).join(n, same).withColumn(name, F.col("__before") + F.col("__here")).select(*rows.columns, name)


def example_ids(examples: DataFrame, order_by: list[str]) -> DataFrame:
    """Adds row number (by declared order within source and target), example, ligand and scaffold ids."""
    x = rank_in_order(examples, ["source", "target"], order_by, "row_idx")
    return x.withColumns(
        {
            "example_id": F.concat_ws(":", F.lit("ex"), "source", "target", F.col("row_idx").cast("string")),
            "ligand_node_id": ligand_id(F.col("smiles_canonical")),
            "scaffold_node_id": scaffold_id(F.col("scaffold_smiles")),
        }
    )


def label_of_id(ident: Column) -> Column:
    """1 for ids of the active prefix, 0 for the decoy prefix, -1 otherwise."""
    return F.when(ident.rlike(r"(?i)^BDB\d+"), 1).when(ident.rlike(r"(?i)^ZINC\d+"), 0).otherwise(-1)


def example_props(label: Column, target: Column, source: Column) -> Column:
    return F.to_json(F.struct(label.alias("label"), target.alias("target"), source.alias("source")), {"ignoreNullFields": "false"})


def emit(examples: DataFrame, decoy_protocol: bool = False, protein_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of examples with ids: example_id, ligand_node_id, scaffold_node_id, source, target, label,
    smiles_canonical, scaffold_smiles; split and label_type where there are such columns. One pass emits all rows of an
    example; rows with an open end go, and a distinct follows per table."""
    e = examples
    node = lambda i, t, l, p=None: F.struct(i.alias("node_id"), F.lit(t).alias("node_type"), l.cast("string").alias("label"), (p if p is not None else F.lit("{}")).alias("props"))
    edge = lambda a, b, t: F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("edge_type"))
    ex, src, tgt = e["example_id"], F.concat(F.lit("src:"), e["source"]), F.concat(F.lit("tgt:"), e["source"], F.lit(":"), e["target"])
    nodes = [
        node(ex, "Example", ex, example_props(e["label"], e["target"], e["source"])),
        node(e["ligand_node_id"], "Ligand", e["smiles_canonical"]),
        node(e["scaffold_node_id"], "Scaffold", F.coalesce(e["scaffold_smiles"], F.lit(""))),
        node(src, "DatasetSource", e["source"]),
    ]
    edges = [edge(ex, e["ligand_node_id"], "example_has_ligand"), edge(e["ligand_node_id"], e["scaffold_node_id"], "ligand_has_scaffold"), edge(ex, src, "example_from_source")]
    if protein_target:
        nodes.append(node(tgt, "ProteinTarget", e["target"]))
        edges.append(edge(ex, tgt, "example_targets_protein"))
    if decoy_protocol:
        decoy = F.concat(F.lit("prot:"), e["source"])
        nodes.append(node(decoy, "DecoyProtocol", e["source"]))
        edges.append(edge(ex, decoy, "example_uses_decoy_protocol"))
    if "split" in e.columns:
        part = F.concat(F.lit("split:"), e["source"], F.lit(":"), e["split"])
        nodes.append(node(part, "Split", e["split"]))
        edges.append(edge(ex, part, "example_in_split"))
    if "label_type" in e.columns:
        kind = F.concat(F.lit("lt:"), e["label_type"])
        nodes.append(node(kind, "LabelType", e["label_type"]))
        edges.append(edge(ex, kind, "example_has_label_type"))
    rows = lambda structs: e.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    return rows(nodes).where("node_id is not null").distinct(), rows(edges).where("src is not null and dst is not null").distinct()


# -- canonicalisation ------------------------------------------------------------------------------------------------
def recode(c: Column, names: dict[str, str], keep_others: bool) -> Column:
    out = F.lit(None).cast("string") if not keep_others else c
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def map_node_types(nodes: DataFrame) -> DataFrame:
    """Raw types to canonical ones; a type in neither list is dropped. ProteinCluster is canonical already."""
    known = {**NODE_TYPE, "ProteinCluster": "ProteinCluster"}
    return nodes.where(F.col("node_type").isin(list(known))).withColumn("node_type", recode(F.col("node_type"), known, True))


def map_edge_types(edges: DataFrame, keep_others: bool = True) -> DataFrame:
    """Raw types to canonical ones; without ``keep_others``, a type that is neither raw nor canonical is dropped."""
    known = {*EDGE_TYPE, *EDGE_TYPE.values(), *OWN_EDGE_TYPE}
    e = edges if keep_others else edges.where(F.col("edge_type").isin(sorted(known)))
    return e.withColumn("edge_type", recode(F.col("edge_type"), EDGE_TYPE, True))


def protein_node(node_id: Column) -> Column:
    """A target or protein id whose last part is an accession, under one id per accession; other ids as they are."""
    acc = accession(F.regexp_extract(node_id, r"^(?:tgt:.*|protein):([^:]+)$", 1))
    return F.when(acc.rlike(ACCESSION), F.concat(F.lit("protein:"), F.lower(acc))).otherwise(node_id)


def trivial_scaffolds(nodes: DataFrame, at_most: int = 6) -> DataFrame:
    """Scaffold nodes whose label has at most so many letters; a null label counts none."""
    return nodes.where(F.col("node_type") == "Scaffold").where(F.coalesce(letter_count(F.col("label")), F.lit(0)) <= at_most)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("node_id").distinct()
    e = edges
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("node_id", end), end, "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), e


def cluster_nodes_edges(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of accession, cluster_id, resolution."""
    cid = F.concat_ws("::", F.lit("ProteinCluster"), "resolution", "cluster_id")
    nodes = clusters.select(cid.alias("node_id"), F.lit("ProteinCluster").alias("node_type"), F.col("cluster_id").alias("label"), F.to_json(F.struct("resolution")).alias("props")).distinct()
    edges = clusters.select(F.concat(F.lit("protein:"), F.lower("accession")).alias("src"), cid.alias("dst"), F.lit("protein_in_cluster").alias("edge_type")).distinct()
    return nodes, edges


def consolidate(nodes: DataFrame, edges: DataFrame, clusters: DataFrame | None = None, assay_cap: int = 5) -> tuple[DataFrame, DataFrame]:
    """Raw to canonical graph, in the order that decides the result: types, protein ids, clusters, trivial scaffolds,
    hub flags (before the prune), dangling prune, direct provenance edges from the raw reference layers (their ends are
    not pruned again), orphan drop, duplicate pairs."""
    from taintgraph.operators import layers

    n, e = graph.rewrite_ids(map_node_types(nodes), map_edge_types(edges, keep_others=False), protein_node)
    if clusters is not None:
        cn, ce = cluster_nodes_edges(clusters)
        n, e = n.unionByName(cn, allowMissingColumns=True), e.unionByName(ce, allowMissingColumns=True)
    n = cut(n, "nodes")
    n, e = drop_nodes(n, e, trivial_scaffolds(n))
    e = cut(e, "edges")  # degrees, prune and orphans each read them
    n = cut(graph.flag_hubs(n, e), "nodes")
    direct = layers.provenance_edges(edges, assay_cap).select(F.col("src"), protein_node(F.col("dst")).alias("dst"), "edge_type")
    e = cut(graph.prune_dangling(n, e).select("src", "dst", "edge_type").union(direct), "edges")
    n = graph.drop_orphans(n, e)
    return n, graph.canonical_pairs(e, ["ligand_similar"]).distinct()


def invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n_bad): repeated ids, ids without a prefix, dangling edges."""
    dup = nodes.groupBy("node_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("duplicate_id").alias("check"), "n_bad")
    pre = nodes.where(~F.contains("node_id", F.lit(":"))).agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("no_prefix").alias("check"), "n_bad")
    ids = nodes.select("node_id").distinct()
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    dang = ends.join(ids, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("dangling_end").alias("check"), "n_bad")
    return dup.union(pre).union(dang)


def assert_invariants(nodes: DataFrame, edges: DataFrame) -> None:
    bad = {r["check"]: r["n_bad"] for r in invariants(nodes, edges).collect() if r["n_bad"]}
    if bad:
        raise ValueError(f"graph invariants broken: {bad}")


# -- maps and provenance ---------------------------------------------------------------------------------------------
def reference_map(bench: DataFrame, ref: DataFrame) -> DataFrame:
    """(dataset, key, text, ref_id, match_method): by key first, by text where the key finds nothing.

    ``bench``: dataset, key, text. ``ref``: ref_id, key, text; of several reference rows the smallest id counts. Both
    matches come from the columns before either is used."""
    by_key = ref.where("key is not null").groupBy("key").agg(F.min("ref_id").alias("by_key"))
    by_text = ref.where("text is not null").groupBy("text").agg(F.min("ref_id").alias("by_text"))
    x = bench.join(by_key, "key", "left").join(by_text, "text", "left")
    how = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_text").isNotNull(), "text").otherwise("unmatched")
    return x.select("dataset", "key", "text", F.coalesce("by_key", "by_text").alias("ref_id"), how.alias("match_method"))


def match_rates(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("dataset", "match_method").agg(F.count(F.lit(1)).alias("n"))


def provenance(activities: DataFrame, documents: DataFrame) -> DataFrame:
    """Activities with their document and a level: how much of the chain value - assay - document is known."""
    d = documents.select("doc_id", F.col("source").alias("doc_source")).groupBy("doc_id").agg(F.min("doc_source").alias("doc_source"))
    x = activities.join(d, "doc_id", "left")
    level = (
        F.when(F.col("doc_source").isNotNull() & F.col("pchembl_value").isNotNull(), "full")
        .when(F.col("doc_source").isNotNull(), "document")
        .when(F.col("assay_id").isNotNull(), "assay")
        .otherwise("none")
    )
    return x.select("activity_id", "assay_id", "doc_id", "doc_source", level.alias("provenance_level"), F.when(F.col("pchembl_value").isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


# -- merge audit -----------------------------------------------------------------------------------------------------
def key_drift(rows: DataFrame) -> DataFrame:
    """Keys written for several texts: (key, n_text, sources). ``rows``: key, text, source."""
    d = rows.where("key is not null and text is not null")
    return d.groupBy("key").agg(F.countDistinct("text").alias("n_text"), F.sort_array(F.collect_set("source")).alias("sources")).where("n_text > 1")


def drift_by_corpora(drift: DataFrame) -> DataFrame:
    """(corpora, n_keys): how many keys each set of corpora writes for several texts. ``drift``: as from :func:`key_drift`."""
    return drift.groupBy(F.array_join("sources", "+").alias("corpora")).agg(F.count(F.lit(1)).alias("n_keys"))


def example_ghosts(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, ligand_id, n_examples) of triples that more than one example row states."""
    end = lambda t, c: edges.where(F.col("edge_type") == t).select(F.col("src").alias("example"), F.col("dst").alias(c)).distinct()
    x = end("example_has_ligand", "ligand_id").join(end("example_has_protein", "target_id"), "example").join(end("example_from_source", "source_id"), "example")
    return x.groupBy("source_id", "target_id", "ligand_id").agg(F.count(F.lit(1)).alias("n_examples")).where("n_examples > 1")


def prefix_drift(rows: DataFrame) -> DataFrame:
    """14-letter blocks that several whole keys share: (block, n_keys)."""
    d = rows.where("key is not null").select(F.substring("key", 1, 14).alias("block"), "key")
    return d.groupBy("block").agg(F.countDistinct("key").alias("n_keys")).where("n_keys > 1")


def ghost_triples(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, n) of edges delivered more than once."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ghost_histogram(ghosts: DataFrame) -> DataFrame:
    return ghosts.groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("n_triples"))


# -- side table, hydration, trainsets --------------------------------------------------------------------------------
def dedup_side_table(side: DataFrame) -> DataFrame:
    """One row per example id, the least by its columns in order."""
    order = [F.struct(*[F.col(c) for c in side.columns])]
    w = Window.partitionBy(clean_id(F.col("example_id"))).orderBy(*order)
    return side.where(clean_id(F.col("example_id")).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def validate_side_table(side: DataFrame, schema: dict[str, str] = SIDE_TABLE) -> DataFrame:
    """(problem, n): missing or extra columns, columns of another type, repeated or null ids, unknown sources."""
    spark, types = side.sparkSession, dict(side.dtypes)
    shape = [(f"missing column {c}", 1) for c in schema if c not in types] + [(f"extra column {c}", 1) for c in types if c not in schema]
    shape += [(f"column {c} is {types[c]}, not {t}", 1) for c, t in schema.items() if c in types and types[c] != t]
    dup = side.groupBy("example_id").count().where("count > 1 and example_id is not null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated example_id").alias("problem"), "n")
    null = side.where("example_id is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("null example_id").alias("problem"), "n")
    odd = side.where(~F.coalesce(F.lower(strip(F.col("source"))).isin(SIDE_SOURCES), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown source").alias("problem"), "n")
    out = dup.union(null).union(odd)
    return out.union(spark.createDataFrame(shape, "problem string, n long")) if shape else out


def hydrate(ids: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, missing) of the distinct wanted ids (example_id), as ids compare."""
    want = ids.select(clean_id(ids["example_id"]).alias("key")).where("key is not null").distinct()
    have = dedup_side_table(side).withColumn("key", clean_id(F.col("example_id")))
    return want.join(have, "key"), want.join(have.select("key"), "key", "left_anti")


def coverage(rows: DataFrame, missing: DataFrame) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("n_found")).withColumn("one", F.lit(1))
    m = missing.agg(F.count(F.lit(1)).alias("n_missing")).withColumn("one", F.lit(1))
    return n.join(F.broadcast(m), "one").select("n_found", "n_missing", F.try_divide("n_found", F.col("n_found") + F.col("n_missing")).alias("coverage"))


def trainset(manifest: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) of a manifest (model, example_id) against known example nodes (node_id)."""
    m = manifest.select("model", F.concat(F.lit("ex:"), clean_id(manifest["example_id"])).alias("node_id")).distinct()
    known = examples.select("node_id").distinct()
    hit = m.join(known, "node_id", "left_semi")
    tid = F.concat(F.lit("trainset:"), "model")
    nodes = hit.select(tid.alias("node_id"), F.lit("TrainSet").alias("node_type"), F.col("model").alias("label"), F.to_json(F.struct("model")).alias("props")).distinct()
    edges = hit.select(F.col("node_id").alias("src"), tid.alias("dst"), F.lit("example_in_trainset").alias("edge_type"))
    return nodes, edges, m.join(known, "node_id", "left_anti")


def resolve_manifest(manifest: DataFrame, id_map: DataFrame) -> DataFrame:
    """Rows (model, source, identifier) of a manifest without example ids, with the example_id that ``id_map`` (source,
    identifier, example_id) gives; null where it has none. Of several ids the least counts."""
    one = id_map.where("example_id is not null").groupBy("source", "identifier").agg(F.min("example_id").alias("example_id"))
    return manifest.select("model", "source", "identifier").join(one, ["source", "identifier"], "left").select("model", "source", "identifier", "example_id")


def ingest_manifest(manifest: DataFrame, examples: DataFrame, id_map: DataFrame | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) of a manifest by example_id or by (source, identifier); of one model where named."""
    m = manifest
    if "model" not in m.columns:
        if model is None:
            raise ValueError("a manifest without models needs a name")
        m = m.withColumn("model", F.lit(model))
    if model is not None:
        m = m.where(F.col("model") == model)
    if "example_id" not in m.columns:
        if id_map is None:
            raise ValueError("a manifest without example ids needs a map of identifiers")
        if not {"source", "identifier"} <= set(m.columns):
            raise ValueError("a manifest has example_id, or both source and identifier")
        m = resolve_manifest(m, id_map)
        nodes, edges, unknown = trainset(m.where("example_id is not null"), examples)
        lost = m.where("example_id is null").select("model", F.concat_ws(":", "source", "identifier").alias("node_id"))
        return nodes, edges, unknown.unionByName(lost.distinct())
    return trainset(m, examples)


def ingest_many(manifests: list[tuple[str, DataFrame]], examples: DataFrame, id_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) of several manifests (model, rows), in one table each."""
    parts = [ingest_manifest(m, examples, id_map, model) for model, m in manifests]
    if not parts:
        raise ValueError("no manifests")
    out = parts[0]
    for p in parts[1:]:
        out = tuple(a.unionByName(b) for a, b in zip(out, p))
    return out


def merge_trainset(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adding the same trainset twice changes nothing."""
    fresh = new_nodes.join(nodes.select("node_id"), "node_id", "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True), edges.select("src", "dst", "edge_type").union(new_edges.select("src", "dst", "edge_type")).distinct()


def upsert_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by a declared order; equal rows are one."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.distinct().withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
