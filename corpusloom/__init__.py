"""Distillation-data analytics expressed as Spark DataFrame operators."""
