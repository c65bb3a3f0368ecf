"""Operators of the text and model problems; nothing outside this folder imports it."""
