"""Operators that prepare text and code for training language models; nothing else in the library imports them."""
