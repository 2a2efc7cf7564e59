"""Garimi: personal-data detection, masking, verification and audit as Spark DataFrame operators."""

__version__ = "0.1.0"
