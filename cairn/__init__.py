"""Cohort analytics as composable DataFrame -> DataFrame operators on Spark."""
