"""Operators for building language-model training corpora, each a DataFrame to DataFrame function."""
