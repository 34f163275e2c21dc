"""Small-matrix helpers. Sizes are columns × columns or parameters × parameters."""

from __future__ import annotations

import numpy as np

RANK_TOLERANCE = 1e-9


def scaled_pinv(gram: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank of a cross-product matrix, judged after unit scaling."""
    gram = (gram + gram.T) / 2
    size = np.sqrt(np.clip(np.diag(gram), 0, None))
    size = np.where(size > 0, size, 1.0)
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    keep = values > RANK_TOLERANCE * max(1.0, values.max(initial=0.0))
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    return inverse / np.outer(size, size), int(keep.sum())


def explained(gram_xx: np.ndarray, gram_xy: np.ndarray) -> tuple[np.ndarray, int]:
    """Y'X (X'X)⁻ X'Y and the rank of X."""
    if gram_xx.shape[0] == 0:
        return np.zeros((gram_xy.shape[1], gram_xy.shape[1])), 0
    inverse, rank = scaled_pinv(gram_xx)
    return gram_xy.T @ inverse @ gram_xy, rank


def descending_eigen(matrix: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs from the greatest value; numerically zero ones dropped.

    Each vector is turned so that its greatest entry in size is positive.
    """
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    keep = values > RANK_TOLERANCE * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    if limit is not None:
        keep[limit:] = False
    values, vectors = values[keep], vectors[:, keep]
    if vectors.size:
        lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(lead < 0, -1.0, 1.0)
    return values, vectors


def unpack_symmetric(values, size: int) -> np.ndarray:
    """Full matrix from its upper triangle, row by row."""
    out = np.zeros((size, size))
    rows, cols = np.triu_indices(size)
    out[rows, cols] = values
    out[cols, rows] = values
    return out
