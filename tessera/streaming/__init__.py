"""Incremental runs.

The batch engine resumes by what is done already; as a stream the same is a
checkpointed query that takes what has arrived and stops.
"""
