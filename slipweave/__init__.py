"""Reconcile payment slips from tables of positioned page text, on Spark DataFrames."""
