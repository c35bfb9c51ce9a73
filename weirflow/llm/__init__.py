"""Training-data operators: mixing, sharding, decontamination, deduplication,
archives, toxicity and main-text extraction.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL twins.
"""
