"""Operators over tables of business operations; every one takes and returns DataFrames."""
