"""Operators: functions from DataFrames to DataFrames over the schemas of keelson.schemas."""
