"""Shelf-price analytics expressed as Spark DataFrame transformations."""
