"""DataFrame operators: ranks, splits, vocabulary, models, metrics."""
