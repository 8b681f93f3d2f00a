"""Plain forms and edit distances of short texts typed by people or read from screens."""

from __future__ import annotations

import re
import unicodedata

_BETWEEN = re.compile(r"(?<=[^\W\d_])[0|](?=[^\W\d_])")


def unaccented(text: str) -> str:
    """``text`` without combining marks (NFKD); letters that don't decompose stay."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def unread(text: str) -> str:
    """Undoes the screen reader's usual errors: 0 and | between letters, I inside lower case."""
    text = _BETWEEN.sub(lambda m: {"0": "o", "|": "l"}[m.group()], text)
    text = re.sub(r"(?<=[a-zåäöé])I(?=[a-zåäöé]|\b)", "l", text)
    return re.sub(r"(?<=[^\W\d_])0\b|\b0(?=[^\W\d_])", "o", text)


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment), at most ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def typos(a: str, b: str, most: int) -> int:
    """``osa`` where a digit one stands for i or l as needed."""
    forms = lambda t: {t.replace("1", "i"), t.replace("1", "l")} if "1" in t else {t}
    return min(osa(x, y, most) for x in forms(a) for y in forms(b))
