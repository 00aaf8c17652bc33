"""Batch analytics operators for catalog, telemetry and text tables, built on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame that takes column names as parameters and
stays lazy; only model fitting, table writes and unlisted pivot values start a Spark job.
"""
