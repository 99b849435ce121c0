"""Plain versions of the contracts, one text at a time or all against all."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def personal(text: str | None) -> str:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def contamination(text: str | None, items: dict[int, str]) -> tuple:
    doc, hit, found = words(text), set(), set()
    for item, body in items.items():
        w = words(body)
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(doc) - k + 1) if k else ():
            if tuple(doc[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return (
        len(doc),
        len(hit),
        len(found),
        sha(",".join(sorted(found))),
        bool(hit) and 20 * len(hit) >= len(doc),
    )


def simhash(text: str | None) -> int:
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(texts: dict[int, str | None]) -> dict[int, int]:
    prints = {k: simhash(v) for k, v in texts.items()}
    parent = {k: k for k in texts}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in texts}


def removed(texts: list[bytes], length: int) -> list[list[bool]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def bootstrap(edges, total, confident, support):
    """Words to extract with: (word, value, trusted) edges scored over and over, far past where they settle."""
    seeds = {v for _, v, trusted in edges if trusted}
    score = {v: float(v in seeds) for _, v, _ in edges}
    reach = {w: {v for x, v, _ in edges if x == w} for w in total}
    confidence = {}
    for _ in range(300):
        confidence = {
            w: sum(score[v] for x, v, _ in edges if x == w) / (total[w] + 1)
            for w in total
            if sum(score[v] >= confident for v in reach[w]) >= support
            and sum(x == w for x, _, _ in edges) / (total[w] + 1) >= confident
        }
        score = {
            v: max([float(v in seeds), *(confidence[w] for w in confidence if v in reach[w])]) for v in score
        }
    return {w for w, c in confidence.items() if c >= confident}
