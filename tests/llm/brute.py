"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def components(nodes, linked):
    """Least reachable node of each, over the pairs that *linked* accepts."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fingerprint(text: str | None, width: int = 3) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept_words(texts: dict[int, str | None], width: int) -> dict[int, list[str]]:
    first: dict[tuple, int] = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k:k + width]), i)
    out = {}
    for i, text in texts.items():
        w = words(text)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes: dict[str | None, int], weights, budget: float, most: float) -> dict[str | None, float]:
    """Shares by weight; the excess over the limit is shared again until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done: dict[str | None, float] = {}
    left = budget * sum(sizes.values())
    while len(done) < len(names):
        open_ = [s for s in names if s not in done]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            done |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            done[s] = most * sizes[s]
        left = budget * sum(sizes.values()) - sum(done.values())
    return done


def best(vectors: dict[int, list[float]], query: int, k: int) -> list[tuple[int, int]]:
    ints = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    scored = [(-sum(a * b for a, b in zip(ints[query], v)), i) for i, v in ints.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def cosine(a, b) -> float:
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def frequent_rules(baskets: list[tuple[frozenset, str]], support: float, confidence: float) -> dict[tuple, tuple[float, float]]:
    """All rules tokens -> label that are frequent and confident, by counting every subset."""
    seen: dict[frozenset, int] = defaultdict(int)
    hits: dict[tuple, int] = defaultdict(int)
    for tokens, label in baskets:
        ordered = sorted(tokens)
        for mask in range(1, 1 << len(ordered)):
            part = frozenset(t for i, t in enumerate(ordered) if mask >> i & 1)
            seen[part] += 1
            hits[part, label] += 1
    n = len(baskets)
    rules = {k: (c / seen[k[0]], c / n) for k, c in hits.items() if c >= math.ceil(support * n) and c / seen[k[0]] >= confidence}
    return {
        (p, y): v for (p, y), v in rules.items()
        if not any(rules.get((p - {t}, y), (-1,))[0] >= v[0] for t in p)
    }
