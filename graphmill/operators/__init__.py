"""operators of graphmill."""
