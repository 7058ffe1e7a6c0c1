"""Sources and sinks."""

from . import formats, segments, tables_sink  # noqa: F401
