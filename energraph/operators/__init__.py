"""Relational operators: edges, graph merge, propagation, retrieval, outputs, evaluation."""
