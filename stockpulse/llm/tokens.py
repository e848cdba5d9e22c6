"""Words of whole texts as Python byte strings, for operators that need the words themselves.

`translate` tables map a text's bytes so that `bytes.split()` yields the words; long
texts are cut at a separator, so a scan holds the words of about one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

SLICE = 1 << 20


def table(separators: bytes, to: bytes = b" ", also: tuple[bytes, bytes] = (b"", b"")) -> bytes:
    """A translation that lower-cases A-Z and maps every byte of `separators` to `to`."""
    upper = bytes(range(0x41, 0x5B))
    lower = bytes(c + 0x20 for c in upper)
    return bytes.maketrans(upper + separators + also[0], lower + to * len(separators) + also[1])


def parts(data: bytes, ends: bytes = b" ", limit: int = SLICE) -> Iterator[bytes]:
    """Consecutive parts of `data`, cut only in front of a byte of `ends`."""
    at = 0
    while len(data) - at > limit:
        cut = max(data.rfind(e, at + 1, at + limit) for e in (ends[i:i + 1] for i in range(len(ends))))
        if cut < 0:       # one word longer than a slice: up to its end
            found = [p for e in (ends[i:i + 1] for i in range(len(ends))) if (p := data.find(e, at + limit)) >= 0]
            if not found:
                break
            cut = min(found)
        yield data[at:cut]
        at = cut
    yield data[at:]
