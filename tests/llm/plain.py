"""Plain versions of the operators, for small tables: one document after another, every pair looked at."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(docs, min_chars=40, min_docs=5):
    """docs: (id, text). {id: (n_lines, n_dropped, sha256)}"""
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(SPACE).translate(UPPER), set()).add(i)
    out = {}
    for i, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = line.strip(SPACE).translate(UPPER)
            if len(key) < min_chars or len(holders[key]) < min_docs or i == max(holders[key]):
                kept.append(line)
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def greedy_pieces(word, first, further, lone=False):
    """Number of pieces, 1 if the word can't be spelled. first, further: sets of bytes; lone: a piece without letters may begin."""
    at, n = 0, 0
    while at < len(word):
        table = first if at == n == 0 else further
        end = next((e for e in range(min(len(word), at + 200), at, -1) if word[at:e] in table), None)
        if end is None and lone and at == n == 0:
            end = 0
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def simhash(text, width):
    import xxhash

    said = words((text or "").translate(UPPER))
    if not said:
        return 0
    shingles = [" ".join(said[k : k + width]) for k in range(len(said) - width + 1)] or [" ".join(said)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs, width=4, radius=4):
    """{id: (fingerprint, component)}"""
    prints = [(i, simhash(text, width)) for i, text in docs]
    links = [(i, j) for k, (i, f) in enumerate(prints) for j, g in prints[k + 1 :] if (f ^ g).bit_count() <= radius]
    named = components([i for i, _ in prints], links)
    return {i: (f"{f:016x}", named[i]) for i, f in prints}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs, items, window=10):
    """{id: (n_words, n_hit, n_items, sha256)}"""
    windows = {}
    for item, text in items:
        w = item_words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes, out = sorted({len(w) for w in windows}), {}
    for i, text in docs:
        w, hit, found = item_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                got = windows.get(tuple(w[k : k + size]))
                if got:
                    found |= got
                    hit |= set(range(k, k + size))
        names = ",".join(sorted(str(x) for x in found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest())
    return out


def longest_matches(docs, items):
    """{item: (n_words, doc, start, item_start)}: every pair of places looked at."""
    out = {}
    for item, text in items:
        w = item_words(text)
        for i, said in docs:
            d = item_words(said)
            for a in range(len(w)):
                for b in range(len(d)):
                    n = 0
                    while a + n < len(w) and b + n < len(d) and w[a + n] == d[b + n]:
                        n += 1
                    if n:
                        out[item] = min(out.get(item, (0, 0, 0, 0)), (-n, i, b, a))
    return {item: (-m[0], *m[1:]) for item, m in out.items()}


def posteriors(docs, domain_of, domains, vocabulary, evidence):
    """{id: (words, [p])} of naive Bayes over even priors, by mean log-likelihood of known words."""
    from collections import Counter
    from math import exp, log

    said = {i: [w for w in words((text or "").lower())] for i, text in docs}
    counts, every = {d: Counter() for d in domains}, Counter()
    for i, d in domain_of.items():
        counts[d].update(said[i])
        every.update(said[i])
    known = [w for w, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]]
    total = {d: sum(counts[d][w] for w in known) for d in domains}
    weight = {d: {w: log((counts[d][w] + 1) / (total[d] + vocabulary)) for w in known} for d in domains}
    out = {}
    for i, ws in said.items():
        hits = [w for w in ws if w in weight[domains[0]]]
        mean = [sum(weight[d][w] for w in hits) / max(1, len(hits)) for d in domains]
        e = [exp((m - max(mean)) * min(len(hits), evidence)) for m in mean]
        out[i] = (len(ws), [x / sum(e) for x in e])
    return out


def vote(row, voters, labels, k):
    """Similarity-weighted share of label 1 among the k nearest of all voters."""
    near = sorted(((sum(float(x) * float(y) for x, y in zip(row, v)), l) for v, l in zip(voters, labels)), key=lambda x: -x[0])[:k]
    weights = [max(c, 1e-6) ** 2 for c, _ in near]
    return sum(w * l for w, (_, l) in zip(weights, near)) / sum(weights)


def stretches(weight, window, surge, dive):
    """Maximal runs of window sums of dive or more, with one of surge or more, trimmed to lines of weight."""
    n = len(weight)
    sums = [sum(weight[j] for j in range(n) if abs(j - k) <= window // 2) for k in range(n)]
    runs = []
    for k in range(n):
        if sums[k] > 0 and sums[k] >= dive:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
    runs = [(r, [j for j in r if weight[j] > 0]) for r in runs if max(sums[j] for j in r) >= surge]
    return [list(range(h[0], h[-1] + 1)) for r, h in runs if h]


def kept_lines(page, window, surge, dive, share, alone, several):
    """The texts of the lines that stay, from lists of each line's containers."""
    lines, names = page.lines, page.names
    n = len(lines)
    paths = []
    for line in lines:
        path, node = [], line.node
        while node >= 0:
            path.append(node)
            node = page.around[node]
        paths.append(path)
    weight = [x.weight for x in lines]
    heaviest = max((sum(weight[j] for j in range(n) if abs(j - k) <= window // 2) for k in range(n)), default=0)
    scale = min(1.0, share * heaviest / surge)
    runs = stretches(weight, window, surge * scale, dive * scale)
    if not runs:
        return []
    best = max(runs, key=lambda r: sum(weight[j] for j in r))
    total = sum(weight[j] for j in best)
    held = {c: sum(weight[j] for j in best if c in paths[j]) for c in range(len(names))}
    said = [c for c in held if names[c] in ("article", "main")]
    kept = set()
    first = max(said, key=lambda c: (held[c], c), default=None)
    if first is not None and held[first] >= alone * total:
        full = {c: sum(weight[j] for j in range(n) if c in paths[j]) for c in said}
        roots = {c for c in said if c == first or full[c] >= alone * full[first]}
        kept = {j for j in range(n) if roots & set(paths[j])}
    else:
        root = max((c for c in held if c == 0 or 2 * held[c] > total and all(2 * held[x] > total for x in ancestors(page, c) if x)), key=lambda c: len(ancestors(page, c)))
        roots = {root}
        inside = [root in p for p in paths]
        own = [next(c for c in p if names[c] != "td") for p in paths]
        heavy = [j for r in runs for j in r if inside[j] and weight[j] > 0]
        kept = {j for j in range(min(heavy), max(heavy) + 1) if inside[j]}
        owners = {own[j] for j in heavy}
        for way in (range(min(heavy) - 1, -1, -1), range(max(heavy) + 1, n)):
            for j in way:
                if not (lines[j].marked or inside[j] and own[j] in owners):
                    break
                if weight[j] > 0 or lines[j].heading:
                    kept.add(j)
        article = sum(weight[j] for j in range(n) if inside[j])
        for r in stretches([0 if inside[j] else weight[j] for j in range(n)], window, surge * scale, dive * scale):
            r = [j for j in r if not inside[j]]
            many = len([j for j in r if weight[j] >= dive * scale]) >= 2
            if sum(weight[j] for j in r) >= article * (several if many else alone):
                kept |= set(r)
    start = min(kept, default=0)
    above = {0, *ancestors(page, min(roots)), min(roots)}
    if not lines[start].heading:
        for j in range(start - 1, -1, -1):
            if weight[j] >= surge * scale and not (lines[j].heading and not lines[j].marked):
                break
            if lines[j].heading and not lines[j].marked:
                c = lines[j].node
                if c in above or page.around[c] in above and page.around[c] > 0:
                    kept |= {i for i in range(j, start) if lines[i].node == c and (weight[i] > 0 or i == j)}
                break
    return [lines[j].text for j in sorted(kept) if not lines[j].marked]


def ancestors(page, c):
    out = []
    while page.around[c] >= 0:
        c = page.around[c]
        out.append(c)
    return out


def token_file(docs, tokenizer, end_id=2):
    """[(id, start, n_tokens, crc)] in ascending order of id."""
    import struct

    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: d[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def nearest(vectors, queries, k=5):
    """vectors: {id: list}. {query: [(id, score)]}, nearest first, ties to the smaller id."""
    import numpy as np

    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            a = good[q]
            scored = [(-float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), i) for i, b in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def prefix_trie(rows, group=5, heads=9):
    """rows: (conv, turn, role, text). {(smallest member, depth, parent, members, children, leaves, saved, ends)}, sorted."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in turns.items()}
    members, rebuilt = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple(turns.get(c - c % group, [])[:h] + own[h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def clusters(rows, k, rounds, dim=64, scale=1024, seed="3:"):
    """rows: (id, vector). ([(id, cluster, distance)] sorted, centroids), by integers alone."""
    import math

    vectors = [(i, [math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(vectors, key=lambda r: (name(r), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(own[c]) for x in zip(*own[c])] if c in own else old for c, old in enumerate(centroids)]
    return sorted(((-1 if i is None else i, nearest(v), far(v, centroids[nearest(v)])) for i, v in vectors)), centroids
