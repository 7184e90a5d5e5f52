"""The kernel over RDKit, for real molecules; the library is imported only when a column is evaluated or the kernel made.

Molecules are SMILES strings and templates reaction SMARTS.  All functions are pandas UDFs:
Arrow batches, one import a worker.  What cannot be read is null.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(kind: str, one):
    """A pandas UDF of a function of one value; null in, null out, and null for what the library refuses."""

    def run(values: pd.Series) -> pd.Series:
        from rdkit import RDLogger

        RDLogger.DisableLog("rdApp.*")
        return values.map(lambda v: None if v is None else one(v)).astype(object)

    return F.pandas_udf(run, kind)


def _read(smiles: str):
    from rdkit import Chem

    return Chem.MolFromSmiles(smiles)


def _canonical(smiles: str):
    """Without stereo, so that one graph has one text."""
    from rdkit import Chem

    mol = _read(smiles)
    return None if mol is None else Chem.MolToSmiles(mol, isomericSmiles=False)


def _key(smiles: str):
    """The connectivity block of the hashed identifier."""
    from rdkit import Chem

    mol = _read(smiles)
    return None if mol is None else Chem.MolToInchiKey(mol).split("-")[0] or None


def _elements(smiles: str):
    from collections import Counter

    from rdkit import Chem

    mol = _read(smiles)
    return None if mol is None else dict(Counter(a.GetSymbol() for a in Chem.AddHs(mol).GetAtoms()))


def _counts(smiles: str, size: int):
    from rdkit.Chem import rdFingerprintGenerator as G

    mol = _read(smiles)
    return None if mol is None else dict(G.GetMorganGenerator(radius=2, fpSize=size).GetCountFingerprint(mol).GetNonzeroElements())


class ChemistryKernel:
    def __init__(self) -> None:
        if importlib.util.find_spec("rdkit") is None:
            raise ImportError("the chemistry kernel needs the package rdkit")

    def canonical(self, mol: Column) -> Column:
        return _each("string", _canonical)(mol)

    def key(self, mol: Column) -> Column:
        return _each("string", _key)(mol)

    def split(self, mol: Column) -> Column:
        return _each("array<string>", lambda s: sorted(c for p in s.split(".") if (c := _canonical(p))))(mol)

    def fingerprint(self, mol: Column, size: int = 1024) -> Column:
        return _each("map<int,int>", lambda s: _counts(s, size))(mol)

    def elements(self, mol: Column) -> Column:
        return _each("map<string,int>", _elements)(mol)

    def apply(self, template: Column, mol: Column) -> Column:
        """Products of each way in which the template fits, canonical and each once; empty if it does not fit."""

        def run(templates: pd.Series, mols: pd.Series) -> pd.Series:
            from rdkit import Chem
            from rdkit.Chem import rdChemReactions as R

            held: dict = {}

            def one(t, s):
                if t is None or s is None or (target := _read(s)) is None:
                    return []
                if t not in held:
                    held[t] = R.ReactionFromSmarts(t)
                made = {".".join(sorted(Chem.MolToSmiles(p, isomericSmiles=False) for p in ps)) for ps in held[t].RunReactants((target,))}
                return sorted(c for m in made if (c := _canonical(m)))

            return pd.Series([one(t, s) for t, s in zip(templates, mols, strict=True)], dtype=object)

        return F.pandas_udf(run, "array<string>")(template, mol)
