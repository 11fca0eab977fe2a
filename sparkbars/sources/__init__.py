"""Reading, normalising and writing bar tables."""
