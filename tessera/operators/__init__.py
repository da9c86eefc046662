"""Operators on DataFrames: relational, search, nearest neighbours, spatial, evaluation."""
