"""pairloom: satellite-pair preprocessing as Spark relations, expressions and Arrow kernels."""
