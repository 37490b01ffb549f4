"""Supervisory analytics over object-centric event logs, expressed as Spark plans."""
