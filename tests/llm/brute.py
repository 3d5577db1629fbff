"""Plain-Python forms of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(ids: list, links) -> dict:
    """Smallest id reachable from each id."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


CLOSING = "[\"')\\]}\u2019\u201d\u00bb\u300d\u300f\uff09]*"
SENTENCE = re.compile(rf"(?:[.!?\u2026]{CLOSING}(?=[\x20\x09-\x0D]|\Z)|[\u3002\uff01\uff1f]{CLOSING}|\n)")


def solid(text: str) -> str:
    """The text without ASCII white space, A-Z as a-z."""
    return re.sub("[\x20\x09-\x0D]", "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def sentences(text: str | None) -> list[str]:
    """Sentences, whose texts put together are the text; blank ones belong to the one after, or to the last."""
    out, at, blank = [], 0, ""
    text = text or ""
    for end in [*(m.end() for m in SENTENCE.finditer(text)), len(text)]:
        piece, at = blank + text[at:end], end
        if solid(piece):
            out.append(piece)
            blank = ""
        else:
            blank = piece
    if out:
        out[-1] += blank
    return out
