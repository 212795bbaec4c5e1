"""Analytics over native-code execution traces, on Spark."""
