"""Column functions; each takes and returns Spark columns unless it says otherwise."""
