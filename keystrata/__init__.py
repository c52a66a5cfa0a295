"""A versioned key-value engine on Spark: a change log, sorted runs and views of them."""
