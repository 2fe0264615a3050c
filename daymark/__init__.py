"""daymark: dated lake tables on Spark.

Everything here is a DataFrame or SQL plan.  Nothing ships Python to the
executors, and the only data that reaches the driver is a list of calendar days
whose length is checked first (see ``operators.days``).
"""

__version__ = "0.1.0"
