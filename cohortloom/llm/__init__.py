"""Operators for training-data preparation; nothing outside this folder imports it."""
