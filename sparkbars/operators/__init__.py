"""Relational operators over bars, events, labels, trades and orders."""
