"""Operators of the domain over DataFrames."""
