"""Memory of the Python workers; see :mod:`seqbin.memory`."""

from seqbin.memory import give_back

__all__ = ["give_back"]
