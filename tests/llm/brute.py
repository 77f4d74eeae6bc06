"""Plain one-machine versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

GAP = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substrings(texts: list[str | None], size: int = 400) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + size] for b in raw for k in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def without_passages(texts: list[str | None], size: int) -> list[str | None]:
    """Texts without words of strings of ``size`` words that two texts have."""
    places = [[(m.start(), m.group()) for m in GAP.finditer(t or "")] for t in texts]
    owners = defaultdict(set)
    for d, words in enumerate(places):
        for k in range(len(words) - size + 1):
            owners[tuple(w for _, w in words[k : k + size])].add(d)
    out = []
    for text, words in zip(texts, places, strict=True):
        gone = set()
        for k in range(len(words) - size + 1):
            if len(owners[tuple(w for _, w in words[k : k + size])]) > 1:
                gone.update(range(k, k + size))
        if text is not None:
            ends = [at for at, _ in words[1:]] + [len(text)]
            lead = text[: words[0][0]] if words else text
            text = lead + "".join(text[a:b] for k, ((a, _), b) in enumerate(zip(words, ends)) if k not in gone)
        out.append(text)
    return out


def base_rules(text: str | None) -> tuple:
    text = text or ""
    words = GAP.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if GAP.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def simhash(text: str | None) -> str:
    words = GAP.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return f"{bits:016x}"


def near_components(ids: list, prints: list[int], radius: int = 4) -> list:
    p = np.array(prints, np.uint64)
    label = np.arange(len(p))
    while True:
        new = label.copy()
        for k in range(len(p)):
            near = np.bitwise_count(p ^ p[k]) <= radius
            new[k] = label[near].min()
        if np.array_equal(new, label):
            break
        label = new
    least = {}
    for i, x in zip(ids, label.tolist(), strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label.tolist()]


def leak_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(texts: list[str | None], items: list[tuple], window: int = 10) -> list[tuple]:
    by_window = defaultdict(set)
    for item, text in items:
        words = leak_words(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            by_window[tuple(words[k : k + window])].add(item)
    sizes = {len(w) for w in by_window}
    out = []
    for text in texts:
        words, hit, found = leak_words(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in by_window:
                    hit.update(range(k, k + n))
                    found |= by_window[w]
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((len(words), len(hit), len(names), digest, bool(hit)))
    return out
