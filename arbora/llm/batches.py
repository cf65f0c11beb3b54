"""Handing texts to vectorised code in slices of bounded size."""

from arbora.functions.batches import SLICE_CHARS, slices

__all__ = ["SLICE_CHARS", "slices"]
