"""Operators from frames to frames: layouts, scaffolds, splits, matrices and tiles."""
