"""Plain single-machine versions of the operators, to compare with."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clean_lines(docs: list[tuple], min_sites: int) -> dict:
    """``docs`` are (doc_id, text, source) with distinct ids; texts by id."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in sorted(docs, key=lambda d: d[0]):
        for at, line in enumerate((text or "").split("\n")):
            key = line.strip(" ")
            if key:
                if source is not None:
                    sites[key].add(source)
                first.setdefault(key, (doc_id, at))
    out = {}
    for doc_id, text, _ in docs:
        if text is None:
            out[doc_id] = None
            continue
        keep = [
            line for at, line in enumerate(text.split("\n"))
            if len(sites[line.strip(" ")]) < min_sites or first[line.strip(" ")] == (doc_id, at)
        ]
        out[doc_id] = "\n".join(keep)
    return out


def targets(sizes: dict) -> dict:
    """Words per source to target words, by repeated re-sharing of what is above 3 times."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        rate = rest / open_weight if open_weight else 0.0
        above = {s for s in names if s not in full and 3 * sizes[s] <= rate * weight[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else rate * weight[s] for s in names}
        full |= above


def taken(docs: list[tuple]) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source)."""
    sizes = defaultdict(int)
    rows = [(d, len(WORD.findall(t or "")), s, hashlib.md5((t or "").encode()).hexdigest()) for d, t, s in docs]
    for _, n, s, _ in rows:
        sizes[s] += n
    goal, out = targets(sizes), []
    for source in sizes:
        budget = math.floor(goal[source] + 0.5)
        rounds, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        own = [r for r in rows if r[2] == source]
        own.sort(key=lambda r: (hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{r[3]}".encode()).hexdigest(), r[1]))
        for doc_id, n, _, _ in own:
            out.append((doc_id, n, sizes[source], goal[source], rounds * n + max(0, min(rest, n))))
            rest -= n
    return out


def groups(similar: np.ndarray) -> np.ndarray:
    """The smallest index of each index's connected component."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def jaccard(texts: list[str], shingle: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of word shingles under the same idf, from exact strings."""
    split = [t.split() for t in texts]
    df = defaultdict(int)
    for words in split:
        for w in set(words):
            df[w] += 1
    n = len(texts)
    idf = lambda w: 1 + math.log((1 + n) / (1 + df[w])) / math.log(1 + n)
    bags = []
    for words in split:
        bag = defaultdict(float)
        span = min(len(words), shingle)
        for i in range(len(words) - span + 1 if words else 0):
            part = words[i : i + span]
            bag[tuple(part)] += sum(map(idf, part)) / span
        bags.append(bag)
    out = np.zeros((n, n))
    holders = defaultdict(list)
    for i, bag in enumerate(bags):
        for key in bag:
            holders[key].append(i)
    for i, bag in enumerate(bags):
        for j in {j for key in bag for j in holders[key] if j < i}:
            shared = sum(min(v, bags[j].get(k, 0)) for k, v in bag.items())
            out[i, j] = out[j, i] = shared / (sum(bag.values()) + sum(bags[j].values()) - shared)
    return out


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
