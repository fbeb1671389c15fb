"""contestframe: contest histories, price streams and settlement on Spark DataFrames."""

from contestframe.config import CFG, Config

__all__ = ["CFG", "Config"]
