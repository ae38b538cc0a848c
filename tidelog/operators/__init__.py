"""Operators: DataFrame in, DataFrame out; batch or streaming unless a docstring says otherwise."""
