"""Operators that prepare training data: mixing, splitting, clustering, packing, searching and cleaning."""
