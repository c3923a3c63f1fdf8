"""Operators for large training corpora (documents and web pages); nothing outside imports this."""
