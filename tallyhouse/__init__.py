"""Evidence-first analytics on Spark: registry-driven plans compiled to lazy DataFrames."""
