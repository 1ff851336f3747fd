"""moorgrid: a PySpark-native search, graph and text-corpus engine."""

__version__ = "0.1.0"
