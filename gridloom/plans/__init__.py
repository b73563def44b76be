"""Geometry of layers, expression trees and their lowering to DataFrames."""
