"""Peptide-evidence analytics as Spark DataFrame operators."""
