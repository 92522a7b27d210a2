"""Quillon: DataFrame operators for language-model data on Apache Spark."""
