"""Parsers and writers in plain Python, without Spark: one text or file in, one value out."""
