"""Spark-native real-time commerce warehouse: sources, operators, plans and streams."""
