"""Whole jobs put together from operators: sweeps and the research run."""
