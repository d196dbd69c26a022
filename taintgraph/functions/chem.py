"""Structure features behind a provider, so that a chemistry toolkit can be plugged in where one is installed.

The toolkit provider gives true structure features where a toolkit is installed, and null where none is. The text
provider needs none and never claims to be chemistry: canonical form is the trimmed text, key its md5, parent key that of the longest part,
coarse group the ring skeleton read from the text. All its functions are column expressions."""

from __future__ import annotations

import importlib
import importlib.util
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from taintgraph.functions.text import reduced_smiles, strip


class ContentFeatures(Protocol):
    def canonical(self, text: Column) -> Column: ...
    def key(self, text: Column) -> Column: ...
    def parent_key(self, text: Column) -> Column: ...
    def scaffold(self, text: Column) -> Column: ...


class TextFeatures:
    """Null or blank input gives null everywhere; an acyclic text has the empty scaffold, which is not null."""

    def canonical(self, text: Column) -> Column:
        return F.nullif(strip(text), F.lit(""))

    def key(self, text: Column) -> Column:
        return F.md5(self.canonical(text))

    def parent_key(self, text: Column) -> Column:
        return F.md5(reduced_smiles(text))

    def scaffold(self, text: Column) -> Column:
        first = F.regexp_extract(self.canonical(text), r"([A-Za-z]\d[^.]*\d)", 1)
        return F.when(self.canonical(text).isNotNull(), F.regexp_replace(first, r"\([^()]*\)", ""))


#: the toolkit that is used where it is installed
TOOLKIT = "rdkit"


def toolkit_installed() -> bool:
    return importlib.util.find_spec(TOOLKIT) is not None


def _read(text: str | None):
    """A molecule, or None for what cannot be read."""
    if not text or not text.strip():
        return None
    return importlib.import_module("rdkit.Chem").MolFromSmiles(text.strip())


def _largest(mol):
    """The fragment of most heavy atoms; of equal ones the first by canonical text."""
    chem = importlib.import_module("rdkit.Chem")
    return min(chem.GetMolFrags(mol, asMols=True), key=lambda m: (-m.GetNumHeavyAtoms(), chem.MolToSmiles(m)))


def _canonical(text):
    m = _read(text)
    return None if m is None else importlib.import_module("rdkit.Chem").MolToSmiles(m)


def _key(text):
    m = _read(text)
    return None if m is None else importlib.import_module("rdkit.Chem").MolToInchiKey(m) or None


def _parent_key(text):
    m = _read(text)
    return None if m is None else importlib.import_module("rdkit.Chem").MolToInchiKey(_largest(m)) or None


def _scaffold(text):
    m = _read(text)
    return None if m is None else importlib.import_module("rdkit.Chem.Scaffolds.MurckoScaffold").MurckoScaffoldSmiles(mol=m)


def _fingerprint(text, radius: int = 2, bits: int = 2048):
    m = _read(text)
    if m is None:
        return None
    gen = importlib.import_module("rdkit.Chem.rdFingerprintGenerator").GetMorganGenerator(radius=radius, fpSize=bits)
    return sorted(gen.GetFingerprint(m).GetOnBits())


class ToolkitFeatures:
    """Features by the toolkit, over Arrow batches. Without it, and for texts that cannot be read, all are null: no
    hash stands in for a structure."""

    def _apply(self, f, kind: str, text: Column) -> Column:
        if not toolkit_installed():
            return F.lit(None).cast(kind)
        import pandas as pd

        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            return x.map(f)

        return run(text)

    def canonical(self, text: Column) -> Column:
        return self._apply(_canonical, "string", text)

    def key(self, text: Column) -> Column:
        return self._apply(_key, "string", text)

    def parent_key(self, text: Column) -> Column:
        return self._apply(_parent_key, "string", text)

    def scaffold(self, text: Column) -> Column:
        return self._apply(_scaffold, "string", text)

    def fingerprint(self, text: Column) -> Column:
        return self._apply(_fingerprint, "array<int>", text)


def bits_to_hex(bits: Column, width: int = 2048) -> Column:
    """A set of bit numbers below ``width`` as bytes in hexadecimal, bit 0 first; null stays null."""
    byte = lambda k: F.aggregate(F.filter(bits, lambda b: (b >= 8 * k) & (b < 8 * k + 8)), F.lit(0), lambda acc, b: acc.bitwiseOR(F.pow(F.lit(2), 7 - (b - 8 * k)).cast("int")))
    return F.when(bits.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width // 8 - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), ""))


def hex_to_bits(text: Column) -> Column:
    """The bit numbers of :func:`bits_to_hex`, in order."""
    at = F.sequence(F.lit(0), F.length(text) * 4 - 1)
    digit = lambda i: F.conv(F.substr(text, (i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    return F.when(text.isNotNull(), F.filter(at, lambda i: digit(i).bitwiseAND(F.pow(F.lit(2), 3 - i % 4).cast("int")) > 0))


def generic_scaffold(scaffold: Column) -> Column:
    """All atoms the same and all bonds single, as far as the text shows it."""
    x = F.regexp_replace(scaffold, r"\[[^\]]*\]|Cl|Br|[A-Za-z]", "C")
    return F.regexp_replace(x, r"[=#/\\@+\-]", "")


def featurize(text: Column, provider: ContentFeatures | None = None) -> Column:
    """struct(smiles_input, smiles_canonical, inchikey, scaffold_smiles, parse_ok)."""
    p = provider or TextFeatures()
    return F.struct(
        text.alias("smiles_input"),
        p.canonical(text).alias("smiles_canonical"),
        p.key(text).alias("inchikey"),
        p.scaffold(text).alias("scaffold_smiles"),
        p.canonical(text).isNotNull().alias("parse_ok"),
    )


def letter_count(text: Column) -> Column:
    """Letters only: a stand-in for the number of heavy atoms (``Cl`` counts two)."""
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
