"""Connected components as the core has them, by the name that the operators of this subpackage know."""

from __future__ import annotations

from foliant.operators.components import connected_components

__all__ = ["connected_components"]
