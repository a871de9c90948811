from . import indices, spatial, timekeys

__all__ = ["indices", "spatial", "timekeys"]
