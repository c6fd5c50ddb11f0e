"""Kerbside: trajectory and lane analytics for traffic video on PySpark."""
