"""Whole tools and jobs, put together from operators."""
