"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from ..operators.components import connected_components, no_edges

__all__ = ["connected_components", "no_edges"]
