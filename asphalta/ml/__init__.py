"""Severity model: features, training, evaluation, explanation, errors."""
