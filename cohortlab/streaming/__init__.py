"""Streaming: intentionally empty.

The reference pipeline reads static exports only -- no watermark, stream
window, state or late-data rule exists in it -- so nothing is streamed here.
The one "late data" rule of the study (a snapshot after a commit must not be
visible to it) is the batch as-of join in ``cohortlab.operators.asof``.
"""
