"""What the engine asks of a chemistry: six functions over columns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column


class Kernel(Protocol):
    """All methods map columns to columns, so a kernel may be built-in functions or pandas UDFs."""

    def canonical(self, mol: Column) -> Column:
        """The graph key of a molecule; null if it cannot be read."""

    def key(self, mol: Column) -> Column:
        """The coarser key that sets of available molecules are matched by."""

    def split(self, mol: Column) -> Column:
        """Array of the components; repeats stay."""

    def fingerprint(self, mol: Column, size: int) -> Column:
        """Map of coordinate to count."""

    def apply(self, template: Column, mol: Column) -> Column:
        """Array of products (each possibly of several components); empty if the rule does not fit."""

    def elements(self, mol: Column) -> Column:
        """Map of element to count; null if any part cannot be read."""
