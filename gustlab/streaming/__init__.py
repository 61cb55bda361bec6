"""Streaming: intentionally empty.

The reference scripts read finished monthly files; they have no stream, watermark, event-time window or
state (SURVEY §2.9 lists nothing). No streaming operator is built. The batch operators are plain DataFrame
transformations, so a caller can apply them inside ``foreachBatch`` if an incremental feed ever appears.
"""
