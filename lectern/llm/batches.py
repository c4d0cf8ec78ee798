"""Size of the batches in which texts reach Python."""

from __future__ import annotations

from lectern.session import BATCH_BYTES, bound_batches, lean

__all__ = ["BATCH_BYTES", "bound_batches", "lean"]
