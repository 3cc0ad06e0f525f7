"""Curation and evaluation of annotated, time-ordered frames on Spark DataFrames."""
