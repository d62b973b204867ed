"""Training-data operators (license scan, exact and approximate search, token files, mixing, BPE,
quality scoring, near-duplicate join, secret scan). Nothing else in the library imports this."""
