"""barloom: leak-safe features, labels, audits and evidence for multi-period bar tables on Spark."""

__version__ = "0.1.0"
