"""Connected components, which other operators need too."""

from __future__ import annotations

from ..operators.graph import components

__all__ = ["components"]
