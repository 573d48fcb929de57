"""Training-data operators: tokens, quality, language, toxicity, duplicates, search, contamination, chat, URLs."""
