"""Multilingual message-risk detection as Spark DataFrame transformations."""
