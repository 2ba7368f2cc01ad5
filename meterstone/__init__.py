"""Governed product and revenue metrics as PySpark jobs."""
