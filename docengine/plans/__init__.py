"""Compositions of operators: corpus build, retrieval, evaluation."""
