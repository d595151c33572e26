"""Training-data operators: deduplication, scoring, extraction, filtering, mixing and sharding of documents.

Nothing outside this subpackage imports it. See the README for the method, inputs and limits of each operator.
"""
