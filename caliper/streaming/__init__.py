"""Streaming.

The reference has no streaming sources, watermarks, windows or state: every entry
point reads whole files and exits.  Nothing is built here; the batch operators accept
any DataFrame, so a Structured Streaming source can be scored with
``caliper.operators.models.batch_score`` inside ``foreachBatch`` if ever needed.
"""
