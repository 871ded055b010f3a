"""Operators of a training-data pipeline over document collections; nothing else in the library imports them."""
