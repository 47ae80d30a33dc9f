"""Training-data operators: text cleaning, deduplication, tokens, chat data."""
