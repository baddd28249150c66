"""Operators for text that feeds language models; nothing outside this package imports it."""
