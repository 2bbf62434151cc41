"""Analytics over durable-execution records, on Spark."""
