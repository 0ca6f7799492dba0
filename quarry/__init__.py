"""Quarry: document, relational and graph analytics as Spark DataFrame operators."""
