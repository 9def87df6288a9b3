"""Relational, graph and text operators over DataFrames."""
