"""Connected components of links, as the library has them."""

from ..operators.graph import components

__all__ = ["components"]
