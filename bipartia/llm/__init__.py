"""Training-data operators: canonical names, leak-free splits, hidden duplicates, tokens, leaks, moderation."""
