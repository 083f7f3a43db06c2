"""The separator row of digits, drawn from a small bitmap font."""

from __future__ import annotations

import numpy as np

#: The digits 0 to 9 in seven rows of five cells.
DIGITS = (
    ".###. #...# #..## #.#.# ##..# #...# .###.",
    "..#.. .##.. #.#.. ..#.. ..#.. ..#.. #####",
    ".###. #...# ....# ...#. ..#.. .#... #####",
    "####. ....# ..##. ....# ....# #...# .###.",
    "...#. ..##. .#.#. #..#. ##### ...#. ...#.",
    "##### #.... ####. ....# ....# #...# .###.",
    "..##. .#... #.... ####. #...# #...# .###.",
    "##### ....# ...#. ..#.. .#... .#... .#...",
    ".###. #...# #...# .###. #...# #...# .###.",
    ".###. #...# #...# .#### ....# ...#. .##..",
)


def separator_row(width: int, height: int) -> np.ndarray:
    """White, with the ten digits in black, centred; digits that don't fit are clipped, or left out below 3 pixels."""
    row = np.full((height, width, 4), 255, np.uint8)
    if not width or not height:
        return row

    def measure(scale: int) -> tuple[int, int]:
        gap = max(1, scale // 2)
        return gap, 10 * 5 * scale + 9 * gap

    scale = max(1, height // 9)
    gap, total = measure(scale)
    if total > width - 2:
        if width <= 2:
            return row
        scale = max(1, (width - 2) // 59)
        gap, total = measure(scale)
    cells = [np.array([[c == "#" for c in line] for line in d.split()]) for d in DIGITS]
    x, y = max(0, (width - total) // 2), max(0, (height - 7 * scale) // 2)
    for cell in cells:
        big = np.kron(cell, np.ones((scale, scale), bool))
        part = row[y : y + big.shape[0], x : x + big.shape[1]]
        part[big[: part.shape[0], : part.shape[1]]] = (0, 0, 0, 255)
        x += 5 * scale + gap
    return row
