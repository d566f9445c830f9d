from quantframe.streaming.sinks import log_batches, run_available, snapshot_batches, upsert_batches

__all__ = ["log_batches", "run_available", "snapshot_batches", "upsert_batches"]
