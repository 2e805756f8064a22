from .corpus import read_corpus, read_chunks, write_chunks
from .driver_tables import (
    attach_text, communications_log, escalation_requests, extension_requests, external_feed,
    register, register_texts, table, verdicts,
)
from .embeddings import read_embeddings, write_embeddings
from .records import export_regulatory, to_records, write_drafts, write_pairs
from .register_io import (
    read_register, read_register_parquet, read_register_split, write_register,
)
from .split_csv import csv_records, read_split_csv

__all__ = [n for n in dir() if not n.startswith("_")]
