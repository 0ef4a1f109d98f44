from cellgrove.streaming.quality import quality_stream

__all__ = ["quality_stream"]
