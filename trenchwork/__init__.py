"""Network-connection planning and text preparation on PySpark."""
