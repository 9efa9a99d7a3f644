"""Change-review analytics on Spark: rules, issues, diffs, graphs, retrieval, packing and streams."""
