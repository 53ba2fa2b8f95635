"""Training-data operators: near-duplicates, exact repeats, scoring, mixing, tokens, web archives."""
