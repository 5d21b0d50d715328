"""The embedding job: separate from ingestion, so a slow model never holds up the stream."""

from __future__ import annotations

from casetrail.operators.notes import Embedder, embed_pending, pending
from casetrail.sources.store import Store


def fill_embeddings(store: Store, embedder: Embedder | None = None) -> int:
    """Give every committed note without a vector one. Returns how many.

    The vectors go to the folder of the last committed version. Until that folder is complete its
    notes still count as pending, so a failed run is simply run again.
    """
    version = store.last()[0]
    notes, done = store.read("case_notes"), store.read("note_embeddings")
    waiting = pending(notes, done).count()
    if waiting:
        store.append("note_embeddings", embed_pending(notes, done, embedder), version)
    return waiting
