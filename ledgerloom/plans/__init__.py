"""The registered queries."""

from . import catalogue, files

__all__ = ["catalogue", "files"]
