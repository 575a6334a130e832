"""The results that the contracts of the ten queries ask for, written plainly for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import xxhash

SPACES = b" \t\n\x0b\x0c\r"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    w = raw(text).lower().split()
    grams = [w[i : i + shingle] for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def closed(nodes, edges) -> dict:
    """The least node that each node reaches."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def near_duplicates(docs, radius: int = 4):
    prints = [fingerprint(t) for _, t in docs]
    f = np.array(prints, np.uint64)
    near = [(docs[i][0], docs[j][0]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius).tolist() if i < j]
    group = closed({d for d, _ in docs}, near)
    return [(d, f"{p:016x}", group[d]) for (d, _), p in zip(docs, prints, strict=True)]


def without_windows(docs, window: int = 20):
    first: dict = {}
    for d, t in docs:
        w = raw(t).split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in docs:
        w = raw(t).split()
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d, i) for p in range(i, i + window)}
        out.append((d, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def without_bytes(docs, width: int = 200):
    seen = Counter(raw(t)[i : i + width] for _, t in docs for i in range(len(raw(t)) - width + 1))
    out = []
    for d, t in docs:
        b = raw(t)
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] and 1))
        out.append((d, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out


def shards_needed(sizes: list[int], capacity: int) -> int:
    n, left = 1, capacity
    for s in sizes:
        if s > left:
            n, left = n + 1, capacity
        left -= s
    return n


def sharded(docs, shards: int = 24):
    """(doc_id, size, crc, shard, slot) for unique ids."""
    group = defaultdict(list)
    for d, t in sorted(docs):
        group[t or ""].append(d)
    order = sorted(group, key=lambda t: group[t][0])
    sizes = [len(group[t]) * (len(t.encode()) + 8) for t in order]
    capacity = next(c for c in _upwards(sizes, shards) if shards_needed(sizes, c) <= shards)
    out, shard, left, slot = [], 0, capacity, 0
    for t, s in zip(order, sizes, strict=True):
        if s > left:
            shard, left, slot = shard + 1, capacity, 0
        left -= s
        for d in group[t]:
            out.append((d, len(t.encode()) + 8, crc32(t.encode()), shard, slot))
            slot += 1
    return sorted(out)


def _upwards(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if shards_needed(sizes, m) <= shards else (m + 1, high)
    yield low


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def parsed(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.encode().lower().decode(), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host: str, path: str) -> str | None:
    fits = [r for r in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return max(fits, key=len, default=None)


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n3 = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p for i in range(len(w) - 2) if n3[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((d, len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    return out


def contamination(docs, items, n: int = 10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw(t).lower())
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[k : k + m]))) is not None:
                    found |= got
                    hit |= {*range(k, k + m)}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        out.append((d, *(sum(x[1] == k for x in s) for k in range(3)), sha(base.encode())))
    return out


def pieces(docs):
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = p.encode([t or "" for _, t in docs], num_threads=1)
    return [(d, len(x), sha(",".join(map(str, x)).encode()), sha(p.decode(x).encode())) for (d, _), x in zip(docs, ids, strict=True)]


def tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    n = [len(e.ids) for e in tk.encode_batch([t or "" for _, t in docs], add_special_tokens=False)]
    return [(d, len(raw(t)), k, k > 2048) for (d, t), k in zip(docs, n, strict=True)]
