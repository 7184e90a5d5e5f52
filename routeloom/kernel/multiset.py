"""A kernel without chemistry: a molecule is a multiset of tokens, written ``a.a.b`` within brackets.

A molecule is a string of tokens joined by ``-`` (``a-a-b``); several components are
joined by ``.``.  A template ``a-b>>c.d-d`` takes tokens away and adds components: the
first gets what is left of the molecule.  The fingerprint folds tokens by CRC-32, and here
the applicability test over folded counts is exact unless two tokens share a coordinate.
Everything is a built-in function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(mol: Column) -> Column:
    return F.filter(F.split(mol, "-"), lambda t: t != "")


def _counts(tokens: Column) -> Column:
    keys = F.array_distinct(tokens)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(tokens, lambda t: t == k))))


class MultisetKernel:
    def canonical(self, mol: Column) -> Column:
        part = F.transform(F.split(mol, "[.]"), lambda p: F.array_join(F.array_sort(_tokens(p)), "-"))
        return F.array_join(F.array_sort(F.filter(part, lambda p: p != "")), ".")

    def key(self, mol: Column) -> Column:
        """Letters without case: molecules that differ in case alone match."""
        return F.lower(self.canonical(mol))

    def split(self, mol: Column) -> Column:
        return F.filter(F.split(self.canonical(mol), "[.]"), lambda p: p != "")

    def fingerprint(self, mol: Column, size: int = 1024) -> Column:
        return _counts(F.transform(_tokens(F.translate(mol, ".", "-")), lambda t: (F.crc32(t.cast("binary")) % size).cast("int")))

    def apply(self, template: Column, mol: Column) -> Column:
        sides = F.split(template, ">>")
        need, tokens = _tokens(sides[0]), _tokens(mol)
        count = lambda xs, k: F.size(F.filter(xs, lambda t: t == k))
        fits = F.forall(F.array_distinct(need), lambda k: count(tokens, k) >= count(need, k))
        kinds = F.array_distinct(tokens)
        left = F.flatten(F.transform(kinds, lambda k: F.array_repeat(k, count(tokens, k) - count(need, k))))
        made = F.split(sides[1], "[.]")
        first = F.concat(F.array_join(left, "-"), F.lit("-"), made[0])
        product = self.canonical(F.array_join(F.concat(F.array(first), F.slice(made, F.lit(2), F.size(made))), "."))
        return F.when(fits, F.array(product)).otherwise(F.array().cast("array<string>"))

    def elements(self, mol: Column) -> Column:
        return _counts(_tokens(F.translate(mol, ".", "-")))
