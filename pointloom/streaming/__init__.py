"""Structured Streaming counterparts of what the engine does incrementally."""

from pointloom.streaming.queries import online_kmeans, plateau_steps, upsert_batches, windowed_values

__all__ = ["online_kmeans", "plateau_steps", "upsert_batches", "windowed_values"]
