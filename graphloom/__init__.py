"""graphloom: property-graph, rule and record-keeping operators on PySpark DataFrames."""

__version__ = "0.1.0"
