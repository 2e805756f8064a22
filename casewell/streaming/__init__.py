from .agents import resolution_tick, run_resolution_agent, run_triage, triage_batch
from .ladder import RUNG_SCHEMA, ladder_firings
from .live import (
    bursts_live, channel_counts_live, first_escalations, latest_live, rejected_live, status_counts_live,
    valid_live,
)
from .sequence import numbered_live
from .snapshots import read_latest, upsert_batch, upsert_batches
from .stores import append_batches, file_stream, read_store, run_available
from .timers import DEADLINE_SCHEMA, deadline_firings

__all__ = [n for n in dir() if not n.startswith("_")]
