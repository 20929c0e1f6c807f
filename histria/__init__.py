"""Histria: behavioural-sequence analytics on Spark DataFrames."""
