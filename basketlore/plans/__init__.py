"""Reports built on mining results and run metrics."""
