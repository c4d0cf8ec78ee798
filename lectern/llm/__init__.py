"""Training-data operators: similarity, language, scoring, filtering, mixing, counting."""
