"""Structured Streaming versions of the incremental parts; each equals its batch form."""
