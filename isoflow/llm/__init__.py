"""Training-data operators: packing, quality, dedup, language, URL and licence rules, search, mixing."""
