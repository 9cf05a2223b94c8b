"""symgraph: property graphs of source-code definitions as Spark tables."""

__version__ = "0.1.0"
