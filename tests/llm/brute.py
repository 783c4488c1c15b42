"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def substring_dedup(rows, window=13):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            least[tuple(w[i : i + window])] = min(least.get(tuple(w[i : i + window]), d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def near_dedup(rows, n, num, den=100):
    fold = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if rows[i][0] is None or rows[j][0] is None or not a or not b:
                continue
            if den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(rows, sets)), key=str)


def personal_values(text):
    """Cards, IBANs, ISO dates and e-mail addresses, by splitting at blanks and checking each word."""
    out = set()
    for w in re.split(r"[\s,;()\"']+", text):
        w = w.strip(".:!?")
        if re.fullmatch(r"[2-6]\d{15}", w) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(w))) % 10 == 0:
            out.add(w)
        if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", w) and int("".join(str(int(c, 36)) for c in w[4:] + w[:4])) % 97 == 1:
            out.add(w)
        if re.fullmatch(r"(19|20)\d\d-(0[1-9]|1[0-2])-(0[1-9]|1\d|2[0-8])", w):
            out.add(w)
        if re.fullmatch(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", w) and any(c.isalnum() for c in w.split("@")[0]):
            out.add(w)
    return out


def noisy_or(text, bags, model):
    """One minus the product over a text's sentences of one minus their logistic scores; ``bags`` tells the terms of each sentence."""
    table, b = dict(zip(model.features.tolist(), model.weights.tolist())), bags([(text or "").encode()])
    held = [set() for _ in range(len(b.doc))]
    for row in b.features:
        for s, f in zip(b.sentence.tolist(), row.tolist()):
            held[s].add(f)
    miss = 1.0
    for terms in held:
        miss *= 1 - 1 / (1 + math.exp(-(model.bias + sum(table.get(f, 0.0) for f in terms))))
    return 1 - miss


def mixing(rows, weights=(1, 2, 3), most=3):
    """Copies of each (id, text, source): shares are poured out again until no source is above its cap."""
    size = lambda t: len(WORD.findall(t or ""))
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, t, o in rows if o == s) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(total.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > most * total[s]}
        for s in full or open_:
            target[s] = float(most * total[s]) if full else weight[s] * share
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for i, t, s in rows:
        rate = target[s] / total[s] if total[s] else 0.0
        draw = int(hashlib.sha256(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, size(t), int(rate) + (draw < rate - int(rate))))
    return target, out
