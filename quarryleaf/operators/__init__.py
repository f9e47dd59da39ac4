"""Operators: DataFrame to DataFrame, without actions."""
