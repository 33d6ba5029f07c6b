"""Plain versions of the operators' rules, for small inputs."""

import math
import random
import re
import zlib
from collections import Counter
from html import unescape

import xxhash


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def components(nodes, linked):
    """The least node that each reaches; ``linked`` of two positions says whether they are joined."""
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j) and find(i) != find(j):
                parent[find(i)] = find(j)
    least = {}
    for i, n in enumerate(nodes):
        least[find(i)] = min(least.get(find(i), n), n)
    return [least[find(i)] for i in range(len(nodes))]


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unigrams(rows):
    """doc_id, held out, tokens, known tokens, base score of each row, and the training tokens."""
    tokens = [[*words(t), "\0"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    score = lambda ws: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), score(ws)) for (i, _), ws, h in zip(rows, tokens, held, strict=True)], n


def interpolated(rows):
    """The log10 probability of all held-out texts by 0.7 of the bigram's share and 0.3 of the smoothed word's."""
    pairs, words_, score = Counter(), Counter(), 0.0
    texts = [(i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*words(t), "\0"]) for i, t in rows]
    for held, w in texts:
        if not held:
            words_.update(w)
            pairs.update(zip(["\0", *w], w, strict=False))
    n, v = sum(words_.values()), len(words_)
    for held, w in texts:
        if held:
            for a, b in zip(["\0", *w], w, strict=False):
                p = (words_[b] + 0.5) / (n + 0.5 * (v + 1))
                score += math.log10(0.7 * pairs[a, b] / words_[a] + 0.3 * p if words_[a] else p)
    return score


def tables(c, a, discount):
    """Chances of 1 to c tables, of weight S(c, t) * a**t, by the recurrence of S."""
    weights = [1.0]
    for n in range(1, c):
        weights = [((n - discount * (t + 1)) * weights[t] if t < n else 0) + (a * weights[t - 1] if t else 0) for t in range(n + 1)]
        weights = [w / max(weights) for w in weights]
    return [w / sum(weights) for w in weights]


def seated(customers, parent, strength, discount, sweeps):
    """Mean tables of each dish of one restaurant, whose customers leave their tables and choose anew one after another."""
    rng = random.Random(3)
    dishes, means = [[1] * c for c in customers], [0.0] * len(customers)
    for sweep in range(sweeps):
        for d, tables_ in enumerate(dishes):
            for _ in range(customers[d]):
                left = rng.choices(range(len(tables_)), tables_)[0]
                tables_[left] -= 1
                if not tables_[left]:
                    tables_.pop(left)
                new = (strength + discount * sum(map(len, dishes))) * parent[d]
                to = rng.choices(range(len(tables_) + 1), [*(n - discount for n in tables_), new])[0]
                if to == len(tables_):
                    tables_.append(0)
                tables_[to] += 1
        if sweep >= 100:
            means = [m + len(t) / (sweeps - 100) for m, t in zip(means, dishes, strict=True)]
    return means


def pitman_yor(rows, strength, parent_strength, discount, burn, sweeps):
    """log10 probabilities of texts by bigrams, all of whose customers, the parent's too, leave their tables and choose anew one after another."""
    rng = random.Random(4)
    pairs = {i: list(zip(["\n", *words(t)], [*words(t), "\n"], strict=True)) for i, t in rows}
    moves = [p for i, ps in pairs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for p in ps]
    known = 1 + len({w for _, w in moves})
    seats, top, opened, all_opened, sizes = {}, {}, {}, [0], {}

    def sit(tables_, new):
        to = rng.choices(range(len(tables_) + 1), [*(n - discount for n in tables_), new])[0]
        if to == len(tables_):
            tables_.append(0)
        tables_[to] += 1
        return tables_[to] == 1

    def leave(tables_):
        left = rng.choices(range(len(tables_)), tables_)[0]
        tables_[left] -= 1
        if not tables_[left]:
            tables_.pop(left)
            return True
        return False

    def parent(w):
        mine, customers = top.get(w, []), sum(opened.values())
        return (sum(mine) - discount * len(mine) + (parent_strength + discount * all_opened[0]) / known) / (parent_strength + customers)

    def arrive(u, w):
        sizes[u] = sizes.get(u, 0) + 1
        if sit(seats.setdefault((u, w), []), (strength + discount * opened.get(u, 0)) * parent(w)):
            opened[u] = opened.get(u, 0) + 1
            all_opened[0] += sit(top.setdefault(w, []), (parent_strength + discount * all_opened[0]) / known)

    def depart(u, w):
        sizes[u] -= 1
        if leave(seats[u, w]):
            opened[u] -= 1
            all_opened[0] -= leave(top[w])

    for u, w in moves:
        arrive(u, w)
    means = dict.fromkeys((p for ps in pairs.values() for p in ps), 0.0)
    for sweep in range(burn + sweeps):
        for u, w in moves:
            depart(u, w)
            arrive(u, w)
        if sweep >= burn:
            for u, w in means:
                mine = seats.get((u, w), [])
                means[u, w] += (sum(mine) - discount * len(mine) + (strength + discount * opened.get(u, 0)) * parent(w)) / (strength + sizes.get(u, 0)) / sweeps
    return {i: sum(math.log10(means[p]) for p in ps) for i, ps in pairs.items()}


def repeated_windows(docs, n):
    """Of each document the starts of n-word windows that a lesser document has too."""
    seen, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if seen.setdefault(key, i) != i:
                out.setdefault(i, set()).add(j)
    return out


def article(html):
    """The blocks of the one article of a test page: its headings and paragraphs, without what stands in other containers in it."""
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", html or "")
    inner = "".join(re.findall(r"(?s)<article[^>]*>(.*?)</article>", inner))
    inner = re.sub(r"(?s)<(aside|nav|form|section|footer|div)\b.*?</\1>", "\n", inner)
    blocks = re.split(r"\n|</?(?:p|h\d|li|ul|ol|blockquote)\b[^>]*>", re.sub(r"<br[^>]*>", " ", inner))
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return [b for b in blocks if b] or [""]
