"""Plumbline: drawing-fidelity analytics as Spark DataFrame operators."""
