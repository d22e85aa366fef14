"""Stretches that a text shares with quotes."""

from __future__ import annotations


def common_stretches(text: str, quotes: list[str], least: int) -> list[list[tuple[int, int, int]]]:
    """For each quote, (shift, lo, hi) of the longest stretches quote[lo:hi] == text[lo + shift : hi + shift] of `least` characters or more.

    Anchors of half that length, so far apart that each such stretch holds a whole one, are looked up and extended to both sides.
    """
    size = (least + 1) // 2
    out = []
    for quote in quotes:
        found, ends = [], {}
        for at in range(0, len(quote) - size + 1, least - size + 1):
            place = text.find(quote[at : at + size])
            while place >= 0:
                shift = place - at
                if ends.get(shift, -1) < at + size:  # else it lies in a stretch that an earlier anchor has given
                    lo, hi = at, at + size
                    while lo > 0 and lo + shift > 0 and quote[lo - 1] == text[lo + shift - 1]:
                        lo -= 1
                    while hi < len(quote) and hi + shift < len(text) and quote[hi] == text[hi + shift]:
                        hi += 1
                    ends[shift] = hi
                    if hi - lo >= least:
                        found.append((shift, lo, hi))
                place = text.find(quote[at : at + size], place + 1)
        out.append(found)
    return out
