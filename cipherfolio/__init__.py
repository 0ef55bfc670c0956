"""Cryptographic inventory analytics as Spark DataFrame transforms."""
