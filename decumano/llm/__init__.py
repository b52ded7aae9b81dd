"""Operators for text corpora and free text; nothing else in the package imports this subpackage."""
