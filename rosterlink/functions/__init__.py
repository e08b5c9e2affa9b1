"""Column functions: text cleaning, rule folding, similarity and comparison levels."""
