"""Long texts in segments, so that what a task holds for a text beside the text itself stays bounded."""

from __future__ import annotations

import re
from collections.abc import Iterator

SEGMENT_BYTES = 1 << 20


def segments(data: bytes, breaks: re.Pattern, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """`data` in parts of about `size` bytes, each but the last ending with a match of `breaks`."""
    at = 0
    while at < len(data):
        found = breaks.search(data, at + size) if at + size < len(data) else None
        end = found.end() if found else len(data)
        yield data[at:end] if at or end < len(data) else data
        at = end
