"""Analytics over versioned JSON document collections, on Spark."""
