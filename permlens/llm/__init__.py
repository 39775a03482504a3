"""Operators of a training-data pipeline over large document tables; nothing outside this folder imports them."""
