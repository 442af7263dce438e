"""Sequence and text operators for training data; nothing outside this subpackage imports it."""
