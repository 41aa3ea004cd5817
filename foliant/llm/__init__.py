"""Training-data operators: dedup, mixing, chat windows, fingerprints, quality, packing, tokens, URLs."""
