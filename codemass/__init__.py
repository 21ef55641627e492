"""Analytics over source repositories as Spark jobs."""
