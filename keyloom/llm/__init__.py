"""Operators for text collections used as language-model training data; nothing outside this subpackage imports it."""
