"""Tokenizing streams: the batch plan as it is, for it keeps nothing between rows."""
