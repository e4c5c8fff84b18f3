"""Tessera: relational, text, graph and event analyses as Spark plans."""

__version__ = "0.1.0"
