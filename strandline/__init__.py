"""Latent ordering of observations, and the data work around it, as Spark jobs."""
