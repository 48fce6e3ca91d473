"""Operators over tables and arrays: DataFrame to DataFrame."""
