"""Slow, plain versions of the corpus operators that the tests compare with."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict

import numpy as np


def words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def gram_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    m = min(n, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1))


def similar_pairs(rows: list[tuple[int, str | None]], n: int, threshold: float) -> dict[tuple[int, int], float]:
    """All pairs of ids whose n-gram sets reach the threshold, through an inverted index."""
    sets = [(i, gram_set(t, n)) for i, t in rows if i is not None]
    index = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(at)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for held in index.values():
        for pair in itertools.combinations(held, 2):
            common[pair] += 1
    out: dict[tuple[int, int], float] = {}
    for (x, y), c in common.items():
        (a, s), (b, t) = sets[x], sets[y]
        j = c / (len(s) + len(t) - c)
        if a != b and j >= threshold:
            key = (min(a, b), max(a, b))
            out[key] = max(out.get(key, 0), j)
    return out


def components(pairs) -> dict:
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def duplicate_lines(rows: list[tuple[int, str | None]], n: int, threshold: float) -> dict[tuple[int, int], tuple[int, int]]:
    """Each line that goes -> the line that stays for it."""
    places: dict[str, set] = defaultdict(set)
    for i, t in rows:
        if i is None or t is None:
            continue
        for at, raw in enumerate(t.split("\n")):
            line = re.sub(r"[\r\t]", " ", raw).strip(" ").lower()
            if line:
                places[line].add((i, at))
    def shingle_set(line):
        b = line.encode()
        return frozenset(b[i : i + n] for i in range(len(b) - n + 1)) if len(b) >= n else frozenset([b])

    lines = sorted(places)
    sets = [shingle_set(x) for x in lines]
    index = defaultdict(list)
    for at, s in enumerate(sets):
        for g in s:
            index[g].append(at)
    common: dict = defaultdict(int)
    for held in index.values():
        for pair in itertools.combinations(held, 2):
            common[pair] += 1
    close = [(x, y) for (x, y), c in common.items() if c / (len(sets[x]) + len(sets[y]) - c) >= threshold]
    root = components(close)
    groups = defaultdict(set)
    for at, line in enumerate(lines):
        groups[root.get(at, at)] |= places[line]
    return {x: min(g) for g in groups.values() for x in g if x != min(g)}


def repeated_spans(rows: list[tuple[int, str | None]], least: int) -> set[tuple[int, int, int]]:
    """(id, first word, words): maximal stretches whose every window of ``least`` words occurs twice or more."""
    seen: dict = defaultdict(int)
    docs = [(i, words(t)) for i, t in rows if i is not None]
    for _, w in docs:
        for a in range(len(w) - least + 1):
            seen[tuple(w[a : a + least])] += 1
    out = set()
    for i, w in docs:
        hit = [a for a in range(len(w) - least + 1) if seen[tuple(w[a : a + least])] > 1]
        runs = []
        for a in hit:
            if runs and a == runs[-1][1] + 1:
                runs[-1][1] = a
            else:
                runs.append([a, a])
        out |= {(i, a, b - a + least) for a, b in runs}
    return out


MASK, MULT, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x100000001B3


def mix(x: int) -> int:
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def word_hash(raw: bytes) -> int:
    return mix(sum((c + 1) * BASE**j for j, c in enumerate(raw)) + len(raw) * MULT & MASK)


def quality_scores(text: str | None, model) -> list[float]:
    """Class probabilities: mean of the vectors of all byte n-grams, words and word pairs, then softmax."""
    data, bits, ids = (text or "").encode(), model.params.buckets_log2, []
    for size in model.params.gram_sizes:
        for i in range(len(data) - size + 1):
            r = data[i]
            for c in data[i + 1 : i + size]:
                r = (r * 0x01000193 & 0xFFFFFFFF) ^ c
            ids.append((r * 0x9E3779B1 + size) * 0x85EBCA6B % (1 << 32) >> 32 - bits)
    h = [word_hash(w) for w in re.findall(rb"[^\x00-\x20]+", data)]
    ids += [mix(x) >> 64 - bits for x in h] + [mix(x + y * BASE & MASK) >> 64 - bits for x, y in zip(h, h[1:])]
    z = [sum(float(row[i]) for i in ids) / max(len(ids), 1) + float(b) for row, b in zip(model.table, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def severity(text: str | None, model) -> float:
    """Expected grade: base plus the chance of passing each threshold, from the weights of the distinct words."""
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    score = sum(weight.get(b, 0.0) for b in {word_hash(w.encode()) >> 64 - model.params.buckets_log2 for w in words(text)})
    return model.base + sum(1 / (1 + math.exp(t - score)) for t in model.theta) * bool(words(text))


def content_lines(text: str | None, model) -> dict[int, int]:
    """Line number -> label, by a plain CRF: features counted byte by byte, best sequence by dynamic programming."""
    kind = lambda c: 4 if c in b"\t\n\r " else 1 if c >= 128 or 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 5 if c in b".,;:'\"-" else 0
    raw = (text or "").encode().split(b"\n")
    raw = [x + b"\n" for x in raw[:-1]] + raw[-1:]
    live = [i for i, x in enumerate(raw) if any(kind(c) != 4 for c in x)]
    score = []
    for i in live:
        count = [sum(kind(c) == j for c in raw[i]) for j in range(6)]
        solid, w = len(raw[i]) - count[4], words(raw[i].decode())
        n = max(len(w), 1)
        share = [count[j] / solid for j in (0, 1, 2, 3, 5)]
        f = [*share, *(float(x > 0.15) for x in share), count[4] / len(raw[i]), math.log1p(solid) / 5, solid < 30, len(w) <= 3, solid / n / 10, kind(raw[i][0]) == 2]
        f += [raw[i].strip(b" \t\r\n")[-1:] in (b".", b"?", b"!"), count[2] > 0.5 * (count[1] + count[2]), i == live[0], i == live[-1], sum(a == b for a, b in zip(w, w[1:])) / n, 1]
        score.append(sum(a * float(b) for a, b in zip(f, model.dense)) + sum(float(model.word[word_hash(x.encode()) >> 64 - model.params.word_bits]) for x in w) / n)
    best = [(0.0, []), (score[0], [])] if live else []
    for s in score[1:]:
        best = [max(((b + model.trans[a][to] + s * to, path + [a]) for a, (b, path) in enumerate(best)), key=lambda x: x[0]) for to in (0, 1)]
    if not live:
        return {}
    last = max((0, 1), key=lambda a: best[a][0])
    return dict(zip(live, best[last][1] + [last]))


def cube_sample(units: list[tuple], pi: dict, seed: int) -> set[int]:
    """Numbers of the sampled units (source number, unit, source, n, t): the cube method, one block for each source, then landing."""
    edge, taken, open_ = 1e-9, set(), []

    def walk(x, a, b, draws):
        hand = []
        for u in range(len(x)):
            if edge < x[u] < 1 - edge:
                hand.append(u)
            while len(hand) == 3:
                step = np.cross([a[h] for h in hand], [b[h] for h in hand])
                if abs(step).max() <= 1e-12 * max(1.0, a[hand[0]] * b[hand[1]], a[hand[1]] * b[hand[2]], a[hand[0]] * b[hand[2]]):
                    step = np.array([a[hand[1]], -a[hand[0]], 0.0])
                up = min((1 - x[h]) / s if s > 0 else x[h] / -s for h, s in zip(hand, step) if s)
                down = min(x[h] / s if s > 0 else (1 - x[h]) / -s for h, s in zip(hand, step) if s)
                go = up if next(draws) * (up + down) < down else -down
                for h, s in zip(hand, step):
                    x[h] += go * s
                    x[h] = 0.0 if x[h] < edge else 1.0 if x[h] > 1 - edge else x[h]
                hand = [h for h in hand if edge < x[h] < 1 - edge]
        return x

    for number in sorted({u[0] for u in units}):
        own = sorted((u for u in units if u[0] == number), key=lambda u: (u[1], u[4]))
        p = pi[own[0][2]]
        if not edge < p < 1 - edge:
            taken |= {u[1] for u in own if p > 0.5}
            continue
        rng = np.random.default_rng([seed, 0, number, own[0][1] & 0xFFFFFFFF])
        own = [own[i] for i in rng.permutation(len(own))]
        x = walk([p] * len(own), [u[3] / p for u in own], [u[4] / p for u in own], iter(rng.random(2 * len(own) + 2)))
        taken |= {u[1] for u, v in zip(own, x) if v >= 1 - edge}
        open_ += [(u[0], u[1], u[3] / p, u[4] / p, v) for u, v in zip(own, x) if edge < v < 1 - edge]
    open_.sort(key=lambda u: u[:2])
    rng = np.random.default_rng(seed)
    x = walk([u[4] for u in open_], [u[2] for u in open_], [u[3] for u in open_], iter(rng.random(2 * len(open_) + 2)))
    while len(left := [i for i, v in enumerate(x) if edge < v < 1 - edge]) >= 2:
        i, j = left[:2]
        s = (open_[j][2], -open_[i][2])
        up, down = min((1 - x[i]) / s[0], x[j] / -s[1]), min(x[i] / s[0], (1 - x[j]) / -s[1])
        go = up if rng.random() * (up + down) < down else -down
        x[i], x[j] = x[i] + go * s[0], x[j] + go * s[1]
    for i in left:
        x[i] = float(rng.random() < x[i])
    return taken | {u[1] for u, v in zip(open_, x) if v > 0.5}


def inclusion(tokens: dict, alpha: float, miss: float, keep: float) -> dict:
    """Probabilities by bisection: the largest sample whose sources fall short by ``miss`` together, small sources whole."""
    weight = {s: n**alpha for s, n in tokens.items()}
    total, whole = sum(weight.values()), sum(tokens.values())
    short = lambda size: sum(max(0.0, weight[s] / total - n / size) for s, n in tokens.items())
    low, high = 1e-9, float(whole)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if short(mid) <= miss else (low, mid)
    size = max(float(whole) if short(whole) <= miss else low, keep * whole)
    low, high = 0.0, 1e12
    for _ in range(300):  # one rate for all sources that aren't whole
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(tokens[s], mid * weight[s]) for s in tokens) < size else (low, mid)
    return {s: min(1.0, high * weight[s] / tokens[s]) for s in tokens}
