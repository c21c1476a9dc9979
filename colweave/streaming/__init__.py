"""Incremental result handling.

The reference has no stream processing; its only incremental behaviour is
appending benchmark results to a log and skipping work already recorded
(``resultlog``). Both are expressed as append writes plus an anti join.
"""
