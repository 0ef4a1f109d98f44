from cellgrove.sources.tables import current, read

__all__ = ["current", "read"]
