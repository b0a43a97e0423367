"""Operators: each takes and returns DataFrames and runs no action unless its docstring says so."""
