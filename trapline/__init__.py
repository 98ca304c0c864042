"""Attack-telemetry analytics as plain DataFrame-to-DataFrame functions.

``sources``    log lines, stored tables, and the telemetry view of the test tables
``functions``  column expressions: addresses, classification, times, numbers, display text
``operators``  the data work: ingest, enrich, sessionise, rank, bucket, maintain
``plans``      page-level queries, the named query list and its SQL counterparts
``streaming``  the same work over a growing log
"""
