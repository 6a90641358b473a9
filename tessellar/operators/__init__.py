"""Relational and graph operators over node, edge and snapshot DataFrames."""
