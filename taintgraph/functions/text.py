"""Column expressions for ids, folds and structures; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what counts as a surrounding blank
BLANKS = " \t\n\r\f\v  　﻿"


def strip(c: Column) -> Column:
    """Without surrounding blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def clean_id(c: Column) -> Column:
    """An id as it compares: trimmed, lower case; null when nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def fold_name(c: Column) -> Column:
    """train, val or test however it is spelled; null when it is none of them."""
    x = F.lower(strip(c))
    return (
        F.when(x.rlike("^train"), "train")
        .when(x.rlike("^(val|dev$|development$)"), "val")
        .when(x.rlike("^(test|held|hold)"), "test")
    )


def accession(c: Column) -> Column:
    """Bare accession in upper case: no database prefix, entry name or isoform suffix; null when nothing is left."""
    x = F.upper(F.regexp_replace(c, r"[\s ﻿]+", ""))
    x = F.regexp_replace(x, r"^[A-Z]+\|([^|]*)(\|.*)?$", "$1")
    x = F.regexp_replace(x, r"^[A-Z][A-Z0-9_.]*:", "")
    x = F.regexp_replace(x, r"[|(;,].*$|_[A-Z0-9]*$", "")
    x = F.regexp_replace(x, r"[-.]\d+$", "")
    return F.nullif(x, F.lit(""))


def inchi_block(c: Column) -> Column:
    """First 14 letters of an InChIKey, after dropping the prefix, blanks and letter case; null when shorter."""
    x = F.upper(F.regexp_replace(c, r"[\s ﻿]+", ""))
    x = F.substring(F.regexp_replace(x, "^INCHIKEY=", ""), 1, 14)
    return F.when(x.rlike("^[A-Z]{14}$"), x)


def reduced_smiles(c: Column) -> Column:
    """Longest dot-separated part without stereo marks, bracket atoms replaced by their bare symbol.

    Ties between equally long parts go to the first one in text order, so that the result is one value."""
    parts = F.split(strip(c), r"\.")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    ties = F.array_min(F.filter(parts, lambda p: F.length(p) == longest["n"]))
    x = F.regexp_replace(ties, r"[@/\\]", "")
    x = F.regexp_replace(x, r"\[\d*([A-Z][a-z]?|[a-z])(?:H\d*)?(?:[+-]\d*)?\]", "$1")
    return F.nullif(x, F.lit(""))


def ligand_node(c: Column) -> Column:
    """Node id of a ligand structure; null for a missing or blank one."""
    return F.concat(F.lit("lig:"), F.md5(F.nullif(strip(c), F.lit(""))))


def example_node(c: Column) -> Column:
    """Node id of an example id, as ids compare."""
    return F.concat(F.lit("ex:"), clean_id(c))


#: ``source:source_id`` (fixed format)
EXAMPLE_ID = r"^([a-z][a-z0-9_]*):([^:].*)$"


def example_id(source: Column, source_id: Column) -> Column:
    """``source:source_id``; null where either part is missing, the source holds a colon or the id starts with one."""
    ok = (source != "") & ~F.contains(source, F.lit(":")) & (source_id != "") & ~F.startswith(source_id, F.lit(":"))
    return F.when(ok, F.concat(source, F.lit(":"), source_id))


def parse_example_id(c: Column, strict: bool = False) -> Column:
    """struct(source, source_id); null for a malformed id, or an error if ``strict``. A null id stays null."""
    bad = F.raise_error(F.concat(F.lit("malformed example_id: "), c)) if strict else F.lit(None)
    parts = F.struct(F.regexp_extract(c, EXAMPLE_ID, 1).alias("source"), F.regexp_extract(c, EXAMPLE_ID, 2).alias("source_id"))
    return F.when(c.rlike(EXAMPLE_ID), parts).when(c.isNotNull(), bad)
