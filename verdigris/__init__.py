"""Verdigris: auditable medallion analytics and corpus preparation on PySpark."""
