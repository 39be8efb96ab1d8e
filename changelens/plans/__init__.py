"""How a run is put together: from options to a table, and to text."""
