"""provlake: chain-of-custody and data-provenance analytics on PySpark."""

__version__ = "0.1.0"
