"""Loomery: data-quality, feature, retrieval, graph and corpus operators as Spark DataFrame functions."""
