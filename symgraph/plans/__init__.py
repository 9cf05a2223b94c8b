"""symgraph.plans."""
