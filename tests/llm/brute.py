"""Plain versions of the contracts, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def crc_id(i):
    return zlib.crc32(str(i).encode())


def token_files(docs, end_id=0):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, {}
    for i in sorted(docs):
        ids = [*t.encode(docs[i] or "", add_special_tokens=False).ids, end_id]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(docs):
    enc = tiktoken_encoding()
    out = {}
    for i, text in docs.items():
        ids = enc.encode_ordinary(text or "")
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    return out


def contamination(docs, items, window=13):
    phrases = defaultdict(set)
    for item, text in items.items():
        w = ALNUM.findall(lower(text))
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if w else ():
            phrases[tuple(w[a : a + n])].add(item)
    sizes = {len(p) for p in phrases}
    out = {}
    for i, text in docs.items():
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if got := phrases.get(tuple(w[a : a + n])):
                    found |= got
                    hit.update(range(a, a + n))
        ids = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def repeats(docs, window=20):
    seen, out = set(), {}
    for i in sorted(docs):
        w = BLANK.findall(docs[i] or "")
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k=3):
    w = BLANK.findall(lower(text))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(docs, k=3, percent=90):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    posting = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            posting[s].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        common_ = Counter(j for s in sets[i] for j in posting[s] if j > i)
        for j, n in common_.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def unigram_base(docs):
    tokens = {i: [*BLANK.findall(lower(t)), None] for i, t in docs.items()}
    c = Counter(w for i, ws in tokens.items() if crc_id(i) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (crc_id(i) % 5 == 1, len(ws), sum(w in c for w in ws), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def bigram_scores(docs, training, discount=0.75):
    """log10 probability of each text by a bigram model with absolute discounting and renormalised back-off."""
    tokens = {i: [*BLANK.findall(lower(t)), None] for i, t in docs.items()}
    learn = [ws for i, ws in tokens.items() if training(i)]
    c, n, v = Counter(w for ws in learn for w in ws), sum(map(len, learn)), len({w for ws in learn for w in ws})
    lower_order = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    pairs, after = Counter(p for ws in learn for p in zip(["<", *ws], ws)), defaultdict(list)
    for a, b in pairs:
        after[a].append(b)

    def p(a, b):
        if a not in after:
            return lower_order(b)
        total = sum(pairs[a, x] for x in after[a])
        if (a, b) in pairs:
            return (pairs[a, b] - discount) / total
        return discount * len(after[a]) / total / (1 - sum(map(lower_order, after[a]))) * lower_order(b)

    return {i: sum(log10(p(a, b)) for a, b in zip(["<", *ws], ws)) for i, ws in tokens.items()}


def line_removals(docs, threshold=0.8):
    """(kept lines) per document: a line goes if an earlier line has a word-set Jaccard of the threshold or more."""
    lines, earlier, out = [], defaultdict(list), {}
    for i in sorted(docs):
        kept = []
        for text in (docs[i] or "").split("\n"):
            words = set(BLANK.findall(text))
            counts = Counter(j for w in words for j in earlier[w])
            gone = any(n >= threshold * (len(words) + len(lines[j]) - n) - 1e-9 for j, n in counts.items())
            if words:
                for w in words:
                    earlier[w].append(len(lines))
                lines.append(words)
            if not gone:
                kept.append(text)
        out[i] = kept
    return out
