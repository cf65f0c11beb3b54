"""Handing texts to vectorised code in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Characters of text that one slice holds, unless a single text is longer.
SLICE_CHARS = 1_500_000


def slices(batches: Iterator[pd.DataFrame], col: str = "text", limit: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """Arrow batches cut further, so that the working memory follows ``limit`` and not the batch."""
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        part = (pdf[col].str.len().fillna(0).cumsum() // limit).to_numpy()
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            yield pdf.iloc[a:b].reset_index(drop=True)
