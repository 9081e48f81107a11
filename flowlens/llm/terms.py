"""Terms of whole texts as bytes: maximal runs of kept bytes, A-Z lowered.

All bytes of characters beyond ASCII are kept, so runs of bytes are the runs
of characters that a pattern excluding other ASCII finds.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text split at once.
STEP = 1 << 20


def alphabet(digits: bool) -> bytes:
    """Translation that lowers A-Z, keeps letters (and digits) and turns all other ASCII into spaces."""
    kept = {*range(ord("a"), ord("z") + 1), *range(128, 256), *(range(ord("0"), ord("9") + 1) if digits else ())}
    return bytes(low if low in kept else 32 for low in (c + 32 if 65 <= c <= 90 else c for c in range(256)))


def pieces(text: bytes | None, table: bytes, step: int = STEP) -> Iterator[list[bytes]]:
    """Terms of a text in lists of about ``step`` bytes; NULL has none. A term is never cut."""
    clean = (text or b"").translate(table)
    low = 0
    while low < len(clean):
        high = clean.find(b" ", low + step)
        high = len(clean) if high < 0 else high
        yield clean[low:high].split()
        low = high
