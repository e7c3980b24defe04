"""Tallybrook: receipt analytics and text processing on Spark DataFrames."""
