"""hopwise: session-trust analytics and training-data preparation on PySpark."""
