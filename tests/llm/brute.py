"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
import struct
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, width=50):
    """docs: (doc_id, text) -> {(doc_id, text): (n_words, n_removed, kept)}"""
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            d = float("inf") if doc is None else doc
            first[k] = min(first.get(k, d), d)
    out = {}
    for doc, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (float("inf") if doc is None else doc):
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[doc, text] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def token_rows(docs, path, end_id=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    at, out = 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def simhash(text, shingle=4):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash_groups(docs, budget=4):
    import numpy as np

    prints = [simhash(t) for _, t in docs]
    distinct = sorted(set(prints))
    a = np.array(distinct, np.uint64)
    up = list(range(len(a)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget) + i + 1:
            x, y = root(i), root(int(j))
            up[max(x, y)] = min(x, y)
    place = {p: root(i) for i, p in enumerate(distinct)}
    least = {}
    for (doc, _), p in zip(docs, prints):
        if doc is not None:
            least[place[p]] = min(least.get(place[p], doc), doc)
    return [(doc, f"{p:016x}", least.get(place[p])) for (doc, _), p in zip(docs, prints)]


def quality_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            rep[i : i + 5] = [True] * 5
    n, r = len(w), sum(rep)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 10 or 100 * r > 20 * n


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def secret_base(text):
    text = text or ""
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(kinds) for m in rx.finditer(text) if ok(m)]
    n = Counter(f[3] for f in found)
    spans = ",".join(f"{f[3]}:{f[0]}:{f[2]}" for f in sorted(found))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(spans.encode()).hexdigest(), spans


RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def url_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    m = re.match(r"[^/?#]*", rest)
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
    path = re.match(r"[^?#]*", rest[m.end() :])[0]
    best = None
    for h, p, v in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def set_groups(texts):
    """Of each text, the first place in its component of links at 0.8."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in holders.get(x, ()))
        near.update({j: 0 for j in range(i) if not s and not sets[j]})
        for j, n in near.items():
            if 5 * n >= 4 * len(s | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            holders.setdefault(x, []).append(i)
    return [root(i) for i in range(len(sets))]


def _spark_hash(values, seed=42):
    """What the engine's xxhash64 gives for longs and texts, one after another; nulls are passed over."""
    import xxhash

    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >> 63 else seed


def highest_quotients(votes, seats, most):
    """Seats dealt one after another to the highest votes / (2 s + 1), ties to the first."""
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def mix_targets(sizes, weights, repeats):
    """Each source's share of all sizes; what is above its bound is shared out again among the rest."""
    target, rest = {}, dict(enumerate(sizes))
    while rest:
        unit = (sum(sizes) - sum(target.values())) / sum(weights[i % len(weights)] for i in rest)
        over = [i for i in rest if unit * weights[i % len(weights)] > repeats * sizes[i]]
        for i in over or list(rest):
            target[i] = repeats * sizes[i] if over else unit * weights[i % len(weights)]
            del rest[i]
    return [float(target[i]) for i in range(len(sizes))]


def mix_taken(docs, block, seed, shard_words, max_shards, repeats, weights=(1, 2, 3)):
    """docs: (doc_id, source, size). The words that each document gives, by dealing
    blocks one after another and writing every shard's words out; and each shard's (rounds, n, picked)."""
    up = lambda a, b: -(-a // b)
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in docs if s == x) for x in sources]
    targets = mix_targets(sizes, weights, repeats)
    blocks = highest_quotients(targets, round(sum(targets) / block), [up(repeats * n, block) for n in sizes])
    width = max(shard_words, up(sum(sizes), max_shards))
    out, told = Counter(), {}
    for k, source in enumerate(sources):
        shards = {}
        for doc, s, size in docs:
            if s == source:
                row = _spark_hash([source, size])
                place = _spark_hash([doc, row, (seed,)]) % max(1, up(sizes[k], width))
                shards.setdefault(place, []).append((_spark_hash([doc, row, (seed + 1,)]), doc is not None, doc or 0, row, size, doc))
        order = sorted(shards)
        held = [sum(r[4] for r in shards[i]) for i in order]
        for shard, w, b in zip(order, held, highest_quotients(held, blocks[k], [up(repeats * w, block) for w in held])):
            rounds, rest = divmod(min(b * block, repeats * w), w) if w else (0, 0)
            n = up(w, block)
            picked = min(n, round(rest / block))
            turn = (seed * 2654435761 + (k * max_shards + shard) * 40503) % max(n, 1)
            told[source, shard] = (rounds, n, picked)
            at = 0
            for *_, size, doc in sorted(shards[shard], key=lambda r: r[:5]):
                out[doc, size] += 0
                for j in (i // block for i in range(at, at + size)):
                    out[doc, size] += rounds + (((j + 1) * picked + turn) // n > (j * picked + turn) // n)
                at += size
    return out, told, dict(zip(sources, targets))


def quality_kept(stats, rules, rounds=2000):
    """stats: dicts of a document's counts -> whether each is kept, by a plain EM over the documents themselves."""
    import math

    def vote(d, rule):
        _, stat, way, good, bad = rule
        if not d["n_words"]:
            return 0
        value = eval(stat, {"greatest": max}, dict(d))
        return (1 if value <= good else 2 if value > bad else 0) if way == "<" else (1 if value >= good else 2 if value < bad else 0)

    votes = [[vote(d, r) for r in rules] for d in stats]
    share, good, bad, weight = 0.9, [0.99] * len(rules), [0.3] * len(rules), max(2.0, 0.002 * len(stats))

    def posterior(v):
        a = math.log(share) + sum(math.log(g if x == 1 else 1 - g) for x, g in zip(v, good) if x)
        b = math.log(1 - share) + sum(math.log(1 - h if x == 1 else h) for x, h in zip(v, bad) if x)
        return 1 / (1 + math.exp(b - a))

    for _ in range(rounds):
        post = [posterior(v) for v in votes]
        was = (share, *good, *bad)
        share = (sum(post) + 9) / (len(post) + 10)
        for k in range(len(rules)):
            yes, no = [(v[k], p) for v, p in zip(votes, post) if v[k]], [(v[k], 1 - p) for v, p in zip(votes, post) if v[k]]
            good[k] = min(0.9999, max(0.55, (sum(p for x, p in yes if x == 1) + 0.99 * weight) / (sum(p for _, p in yes) + weight)))
            bad[k] = min(0.9999, max(0.001, (sum(p for x, p in no if x == 2) + 0.3 * weight) / (sum(p for _, p in no) + weight)))
        if max(abs(x - y) for x, y in zip(was, (share, *good, *bad))) < 1e-9:
            break
    return [d["n_words"] >= 10 and 100 * d["n_repeat_words"] <= 20 * d["n_words"] and posterior(v) >= 0.5 for d, v in zip(stats, votes)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def hit_in_context(around, at, lists, edge):
    """How much the hit at a place counts among its words; lists: (words of reporting, of address, quotation marks)."""
    reporting, address, marks = lists
    before, after = "".join(around[:at]), "".join(around[at + 1 :])
    opened = len([x for x in before if x in marks]) % 2 == 1 and not marks.isdisjoint(after)
    others = [w.lower().strip(edge) for w in [*around[:at], *around[at + 1 :]]]
    parts = [0.3 if opened or around[at][0] in marks or around[at][-1] in marks else 1.0]
    parts += [0.5] if any(w in reporting for w in others) else []
    parts += [1.5] if any(w in address for w in others) else []
    out = 1.0
    for p in parts:
        out *= p
    return out


def toxicity_score(text, model, edge, context, lists):
    """The score of a text by the distance of each word to each term."""
    import math

    budget = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    w, sums = words(text), [0.0] * 5
    for i, raw in enumerate(w):
        x = raw.lower().strip(edge)
        fits = [(0, -v) for s, v in model.stems.items() if x.startswith(s)]
        fits += [(d, -v) for t, v in model.terms.items() if abs(len(t) - len(x)) <= budget(t) and (d := edit_distance(t, x)) <= budget(t)]
        if not fits:
            continue
        edits, weight = min(fits)
        lo = max(0, i - context)
        c = hit_in_context(w[lo : i + context + 1], i - lo, lists, edge)
        if edits:
            sums[2] += c
        else:
            sums[0] = max(sums[0], -weight * min(c, 1.0))
            sums[1] -= weight * c
            sums[4] += c
        sums[3] += c < 0.6
    sums[4] = max(sums[4] - 1, 0)
    x = [1.0, sums[0] / 5, *(math.log1p(s) for s in sums[1:])]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights))))))


def license_spans(text, templates, least_run, most_gap):
    """(template, start, stop, covered share) by looking each stretch of words up in every template."""
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, lists = token.findall(lower(text)), [token.findall(lower(t)) for _, t in templates]
    longest = []
    inside = lambda a, b: any(w[a:b] == t[i : i + b - a] for t in lists for i in range(len(t) - (b - a) + 1))
    for i in range(len(w)):
        n = (longest[-1] if longest else 0) + 1
        while n and not inside(i + 1 - n, i + 1):
            n -= 1
        longest.append(n)
    chains, open_ = [], {}
    for i, n in enumerate(longest):
        if n < least_run or (i + 1 < len(w) and longest[i + 1] > n):
            continue
        start = i + 1 - n
        for k, t in enumerate(lists):
            places = [a for a in range(len(t) - n + 1) if t[a : a + n] == w[start : i + 1]]
            if not places:
                continue
            c = open_.get(k)
            fit = [a for a in places if c and start - c[1] <= most_gap and a + n > c[2] and i + 1 > c[1]]
            if fit:
                a = min(fit, key=lambda x: (abs(x - c[2]), x))
                c[3] += min(n, a + n - c[2], i + 1 - c[1])
                c[1], c[2] = i + 1, a + n
            else:
                if c:
                    chains.append((k, *c))
                open_[k] = [start, i + 1, places[0] + n, n]
    chains += [(k, *c) for k, c in open_.items()]
    return sorted((k, a, b, min(1.0, n / len(lists[k]))) for k, a, b, _, n in chains)
