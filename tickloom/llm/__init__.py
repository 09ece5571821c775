"""Operators for preparing text for language models; nothing else in the library imports this package."""
