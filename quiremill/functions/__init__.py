from . import columns, ordered

__all__ = ["columns", "ordered"]
