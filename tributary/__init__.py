"""Supply-network analytics on PySpark."""
