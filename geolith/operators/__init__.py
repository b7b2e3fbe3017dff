"""Analytical operators: DataFrames in, DataFrames out."""
