"""trajecta: behavioural session analytics on PySpark."""
