"""Column expressions: text cleaning, text statistics, recoding."""
