"""Operators on signals, windows and scores: functions from DataFrames to DataFrames."""
