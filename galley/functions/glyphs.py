"""Glyph runs of a page: overprints and columns of single letters. Plain functions over one page's items; operators.checks applies them."""

from __future__ import annotations

import unicodedata
from itertools import groupby
from operator import itemgetter

import numpy as np

#: Share of overlap of an overprint; letters and gaps of a vertical run, in heights.
OVERPRINT, RUN, NEAR_X, LEAST_GAP, MOST_GAP = 0.80, 3, 0.38, 0.25, 2.6


def overlap(a: dict, b: dict) -> float:
    """Common area as a share of the smaller box. Boxes hang a fifth of their height below the baseline."""
    wide = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    low, high = (lambda i: i["y"] - 0.2 * i["height"]), (lambda i: i["y"] + 0.8 * i["height"])
    tall = min(high(a), high(b)) - max(low(a), low(b))
    return max(0.0, wide) * max(0.0, tall) / max(1e-9, min(a["width"] * a["height"], b["width"] * b["height"]))


def _printed(item: dict) -> tuple:
    """What two prints of one glyph run have in common: text, font and rounded box."""
    text = unicodedata.normalize("NFKC", " ".join(item["str"].split()))
    return text, item["font"], *(round(item[k] * f) for k, f in (("x", 2), ("y", 2), ("width", 1), ("height", 1)))


def overprints(items: list[dict]) -> list[int]:
    """Places of items that print an earlier one again: the same text, font and rounded box, and most of the area in common."""
    alike = sorted((key, k) for k, key in enumerate(map(_printed, items)) if key[0])
    out = []
    for _, group in groupby(alike, key=itemgetter(0)):
        first, *later = (k for _, k in group)
        shown = [first]
        for k in later:
            (out if max(overlap(items[j], items[k]) for j in shown) >= OVERPRINT else shown).append(k)
    return sorted(out)


def _runs(values: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
    """Stretches of sorted values in which each is joined to the one before."""
    return np.split(values, np.flatnonzero(~joined) + 1) if len(values) else []


def vertical_runs(items: list[dict]) -> list[int]:
    """Places of single letters, each a line of its own, that stand below one another: three or more, evenly apart."""
    letters = np.array([k for k, i in enumerate(items) if i["has_eol"] and len(t := i["str"].strip()) == 1 and t.isalpha()], dtype=int)
    x, y, height = (np.array([float(items[k][c]) for k in letters]) for c in ("x", "y", "height"))
    # columns: places along x, each begun by its first letter
    order = np.argsort(x, kind="stable")
    column, start = np.zeros(len(letters), int), None
    for k in order:
        fresh = start is None or x[k] - x[start] > max(2.0, NEAR_X * height[k])
        start = k if fresh else start
        column[k] = start
    found: list[int] = []
    for c in np.unique(column):
        down = np.flatnonzero(column == c)
        down = down[np.argsort(-y[down], kind="stable")]
        gap, upper, lower = -np.diff(y[down]), height[down][:-1], height[down][1:]
        even = (gap >= np.maximum(1.0, LEAST_GAP * lower)) & (gap <= MOST_GAP * np.maximum(upper, lower))
        found += [int(letters[k]) for run in _runs(down, even) if len(run) >= RUN for k in run]
    return sorted(found)
