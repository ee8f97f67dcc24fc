"""Foliograph: document graphs as Spark tables, and analytical operators over them."""
