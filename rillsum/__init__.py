"""Mergeable stream sketches expressed as Spark DataFrame plans."""

from rillsum.config import CountMinConfig, CountSketchConfig, LogBucketConfig, SpreadConfig, UnivConfig

__all__ = ["CountMinConfig", "CountSketchConfig", "LogBucketConfig", "SpreadConfig", "UnivConfig"]
