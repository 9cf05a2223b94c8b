"""symgraph.sources."""
