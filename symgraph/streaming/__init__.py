"""symgraph.streaming."""
