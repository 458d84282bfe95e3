"""Corpus operators for language-model training data. Nothing outside this folder imports it."""
