"""Prepare, label, sample, select and score labelled text with Spark DataFrames."""
