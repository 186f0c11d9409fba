"""Retail sales analytics as Spark DataFrame jobs."""

from tallybook.star import Star

__all__ = ["Star"]
