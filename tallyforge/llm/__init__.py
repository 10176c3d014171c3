"""Operators for training data: top-n per group, token encoding, mixtures and look-alike text."""
