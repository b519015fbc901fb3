"""Typed property-graph analytics and corpus preparation on PySpark."""
