"""Operators that aren't pixel-wise: neighbourhoods, re-gridding, mosaics, lists of layers."""
