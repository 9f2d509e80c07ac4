"""The cube language: text to DataFrame plans."""

from .parser import CubeError, parse
from .planner import Cube, evaluate

__all__ = ["Cube", "CubeError", "evaluate", "parse"]
