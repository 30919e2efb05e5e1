"""Corpusloom: document and graph analytics over a corpus, expressed as Spark plans."""

__version__ = "0.1.0"
