"""Cohort, annotation and prediction-audit operators on PySpark."""
