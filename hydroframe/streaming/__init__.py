"""Extension: block statistics over a stream of samples (no part of the batch operators)."""
