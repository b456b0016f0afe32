"""Training-data operators: tokens, toxicity, near-duplicates, personal data, licences, packing, quality, search."""
