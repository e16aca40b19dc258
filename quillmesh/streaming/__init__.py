"""Arrival-ordered batches of detections, as micro-batches of Structured Streaming."""
