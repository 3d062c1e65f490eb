"""Plain-Python answers on small fixtures, written straight from the definitions."""

from __future__ import annotations

import math
from itertools import combinations


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def similarity(a, b) -> int:
    if not a or not b:
        return 0
    return 100 if a == b else half_up((1 - edit_distance(a, b) / max(len(a), len(b))) * 100)


def meters(p, q) -> float:
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(c - a) / 2) ** 2
    h += math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def proximity(p, q) -> int:
    if None in (*p, *q):
        return 0
    m = meters(p, q)
    return next((s for limit, s in ((100, 100), (500, 85), (1000, 60), (5000, 30)) if m < limit), 0)


def codes(a, b) -> int:
    if not a or not b:
        return 0
    if a == b:
        return 100
    return next((s for n, s in ((4, 70), (3, 50), (2, 30)) if a[:n] == b[:n]), 0)


def pairs(records: list[dict], review: int = 60) -> dict[tuple[str, str], int]:
    """All cross-source pairs that share a block and reach the review score.

    Streets and cities are expected to be in normal form already.
    """
    found = {}
    for a, b in combinations(sorted(records, key=lambda r: r["id"]), 2):
        if a["source"] == b["source"] or not a["raw_state"] or a["raw_state"] != b["raw_state"]:
            continue
        registered = bool(a["registry_id"]) and a["registry_id"] == b["registry_id"]
        if registered:
            found[a["id"], b["id"]] = 99
            continue
        if (a["raw_zip"] or "000")[:3] != (b["raw_zip"] or "000")[:3]:
            continue
        street, other = a["raw_address"], b["raw_address"]
        address = 40 if street and street == other else half_up(similarity(street, other) * 0.3)
        address += 30 if a["raw_city"] and a["raw_city"] == b["raw_city"] else 0
        if a["raw_zip"] and b["raw_zip"]:
            address += 30 if a["raw_zip"] == b["raw_zip"] else 15 if a["raw_zip"][:3] == b["raw_zip"][:3] else 0
        point = lambda r: tuple(None if r[c] is None else float(r[c]) for c in ("raw_latitude", "raw_longitude"))
        score = half_up(
            similarity(a["raw_name"], b["raw_name"]) * 0.35 + proximity(point(a), point(b)) * 0.30
            + min(100, address) * 0.20 + codes(a["raw_naics_code"], b["raw_naics_code"]) * 0.15
        )
        if score >= review:
            found[a["id"], b["id"]] = score
    return found


def components(edges) -> dict[str, str]:
    label = {}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {x: root(x) for x in label}
