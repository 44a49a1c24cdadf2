"""Operators on DataFrames: selection, index, retrieval, history, audit, queues."""
