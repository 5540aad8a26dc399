"""Training-data operators: scoring, encoding, counting, deduplication, packing and filtering of documents."""
