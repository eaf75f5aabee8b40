"""Streaming form of the run log (an extension: the batch operators do not need it)."""
