"""Operators for preparing large text corpora, apart from the site analytics."""
