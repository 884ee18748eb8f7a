"""Relational operators over corpora: parsing, evidence, graph, retrieval, evaluation."""
