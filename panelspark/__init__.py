"""panelspark: tabular modelling and corpus preparation as Spark DataFrame jobs."""
