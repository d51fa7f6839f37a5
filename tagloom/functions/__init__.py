"""Column functions: text cleaning, keyword matching, numbers."""
