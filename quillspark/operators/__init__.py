"""Relational, retrieval, tree and chunking operators: functions from DataFrame to DataFrame."""
