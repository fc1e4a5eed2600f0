"""Operators for building training corpora: mixing, near-copy joins, language
identification, decontamination, personal data, repeats, nearest neighbours,
toxicity, language-model scoring and boilerplate lines.

Nothing else in the library imports this subpackage.
"""
