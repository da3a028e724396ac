"""Column functions: keys, text normalisers, scores, gates and facts."""
