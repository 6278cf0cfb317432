"""Training-data operators: scoring, filters, tokens, packing, near copies and language models."""
