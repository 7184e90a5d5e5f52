from .base import Kernel
from .chemistry import ChemistryKernel
from .multiset import MultisetKernel

__all__ = ["ChemistryKernel", "Kernel", "MultisetKernel"]
