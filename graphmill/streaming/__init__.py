"""streaming of graphmill."""
