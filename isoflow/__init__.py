"""Splicing-assay analytics and training-data operators as Spark DataFrame transformations."""
