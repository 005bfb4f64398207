"""Training-data operators: quality, dedup, language, toxicity, privacy, tokens, decontamination."""
