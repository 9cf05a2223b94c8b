"""symgraph.operators."""
