"""Analytics over noisy, repeated observations of real-world entities, as Spark jobs."""
