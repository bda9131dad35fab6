"""Array-signal analytics expressed as Spark DataFrame jobs."""

from phasegrid.config import ArrayConfig
from phasegrid.session import build_session

__all__ = ["ArrayConfig", "build_session"]
