"""Cutting lineage in the folder that all executors share."""

from ..session import cut

__all__ = ["cut"]
