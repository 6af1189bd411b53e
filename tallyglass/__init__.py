"""Reconciliation and proof of data movements, expressed as Spark plans."""
