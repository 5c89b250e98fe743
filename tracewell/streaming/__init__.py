"""Trace metrics over a stream of events; an extension beside the batch operators."""

from .sessions import session_jumps

__all__ = ["session_jumps"]
