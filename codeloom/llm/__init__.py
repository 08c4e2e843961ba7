"""Operators that prepare source code and text for language models."""
