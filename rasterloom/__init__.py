"""Curation and evaluation of annotated rasters as DataFrame, SQL and streaming jobs."""
