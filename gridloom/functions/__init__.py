"""Pixel types and the column form of every pixel-wise operator."""
