"""Where changes come from: commit logs, tables, layer maps."""
