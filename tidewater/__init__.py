"""A small relational analytics engine on PySpark DataFrames."""

from .errors import BindError, EngineError, NotSupported, ParseError
from .session import Session

__all__ = ["BindError", "EngineError", "NotSupported", "ParseError", "Session"]
