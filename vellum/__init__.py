"""Vellum: document-corpus analytics expressed as Spark DataFrame jobs."""
