"""Hotspot and moving-event analytics as Spark jobs."""

from hotspark.params import TrackParams
from hotspark.session import get_spark, prepare

__all__ = ["TrackParams", "get_spark", "prepare"]
