"""Operators that prepare text for training. Nothing else in loam imports this subpackage."""
