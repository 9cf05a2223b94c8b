"""symgraph.functions."""
