"""sources of graphmill."""

from graphmill.sources.tables import load

__all__ = ["load"]
