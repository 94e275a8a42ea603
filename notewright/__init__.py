"""Document-record analytics on Spark: text, extraction, merge, graph and quality operators as DataFrame plans."""

__version__ = "0.1.0"
