"""functions of graphmill."""
