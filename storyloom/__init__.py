"""Storyloom: narrative-object and text analytics expressed as Spark DataFrame plans."""
