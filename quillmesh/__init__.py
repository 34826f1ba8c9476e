"""Spark-native analytics over scholarly records, citations and identities."""

from quillmesh.session import load, local_session

__all__ = ["load", "local_session"]
