"""The contracts once more, in plain Python, row by row and pair by pair."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def benchmark_hits(texts, items, window=8):
    """For each text: n_words, n_hit, n_items, sha256 of the items"""
    table = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        if words and item is not None:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                table[tuple(words[i : i + size])].add(str(item))
    sizes = sorted({len(k) for k in table})
    for text in texts:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if names := table.get(tuple(words[i : i + size])):
                    found |= names
                    hit.update(range(i, i + size))
        yield len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def base_scores(rows):
    """rows: (doc_id, text).  For each: held_out, n_tokens, n_known, train_tokens, base_score"""
    def tokens(text):
        return [*WORD.findall((text or "").translate(LOWER)), None]

    count = Counter(t for i, text in rows if i is None or fold(i, 5) != 1 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for i, text in rows:
        own = tokens(text)
        yield i is not None and fold(i, 5) == 1, len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)


def shingles(text, size=2):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words)} - {()} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(rows, size=2, percent=80):
    """rows: (doc_id, text), ids without nulls.  For each: n_shingles, component_id"""
    sets = [frozenset(shingles(t, size)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = {}
    for k, s in enumerate(sets):
        if s:
            parent[find(k)] = find(distinct.setdefault(s, k))
    index = defaultdict(list)
    for s, k in distinct.items():
        for x in s:
            index[x].append((k, s))
    for s, k in distinct.items():
        same = Counter(j for x in s for j, _ in index[x] if j > k)
        for j, n in same.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [(len(s), least[find(k)] if s else rows[k][0]) for k, s in enumerate(sets)]


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_rule(url):
    """host, path, rule, verdict of the rule"""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    host = raw.translate(LOWER)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """counts by kind, sha256 of the spans"""
    spans = {k: [m.span() for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in KINDS.items()}
    named = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
    return *(len(x) for x in spans.values()), hashlib.sha256(named.encode()).hexdigest()


class PlainModel:
    """Interpolated absolute discounting over dictionaries; words that aren't frequent share the mean of theirs and of one unknown word."""

    def __init__(self, texts, frequent, discount):
        self.discount, self.uni, self.n = discount, Counter(), [defaultdict(Counter), defaultdict(Counter)]
        for t in texts:
            for a, b, c in self.events(t):
                self.uni[c] += 1
                self.n[0][b][c] += 1
                self.n[1][a, b][c] += 1
        size = sum(self.uni.values()) + 0.5 * (len(self.uni) + 1)
        rare = [w for w in self.uni if w not in frequent and w != "</s>"]
        self.p1 = {w: (n + 0.5) / size for w, n in self.uni.items() if w not in rare}
        self.rest = (sum(self.uni[w] for w in rare) + 0.5 * (len(rare) + 1)) / size / (len(rare) + 1)

    @staticmethod
    def events(text):
        words = ["<pad>", "<s>", *WORD.findall((text or "").translate(LOWER)), "</s>"]
        return zip(words, words[1:], words[2:])

    def score(self, text):
        total = 0.0
        for a, b, c in self.events(text):
            p = self.p1.get(c, self.rest)
            for counts in (self.n[0].get(b), self.n[1].get((a, b))):
                if counts:
                    n = sum(counts.values())
                    p = max(counts[c] - self.discount, 0) / n + self.discount * len(counts) / n * p
            total += math.log10(p)
        return total


def line_dedup(rows, long_words=10, near=2):
    """Content-defined chunks of lines, one dictionary of their lines; rows (doc_id, text) with different ids, in order."""
    import numpy as np
    import pyarrow as pa

    from flowjob.llm import textkit as K

    def roll(x, y):
        data = pa.array([x, y])
        h = K.span_hashes(*K.buffers(data)[:1], *(np.array(v) for v in zip(*[(0, len(x.encode())), (len(x.encode()), len((x + y).encode()))])))
        return int(K.pair(h[:1], h[1:])[0])

    seen, out = {}, {}
    for doc_id, text in rows:
        every = text.split("\n")
        at = [i for i, x in enumerate(every) if WORD.search(x)]
        some = [every[i] for i in at]
        long = [len(WORD.findall(x)) >= long_words for x in some]
        r = [None if long[i] or long[i + 1] else roll(some[i], some[i + 1]) for i in range(len(some) - 1)]

        def boundary(i):
            if r[i] is None:
                return True
            return (i > 0 and r[i - 1] is not None and r[i] <= r[i - 1]) or (i + 1 < len(r) and r[i + 1] is not None and r[i] < r[i + 1])

        parts, begin = [], 0
        for i in range(len(some)):
            if i + 1 == len(some) or boundary(i):
                first, last = begin, i
                if first == last and not long[first]:
                    if last + 1 < len(some):
                        last += 1
                    elif first:
                        first -= 1
                    else:
                        first = last + 1
                if first <= last:
                    parts.append((first, last))
                begin = i + 1
        gone = set()
        for first, last in parts:
            key = tuple(some[first : last + 1])
            if key not in seen:
                seen[key] = (some, first, last)
                continue
            there, f, t = seen[key]
            gone.update(at[first : last + 1])
            for step, here, other in ((-1, first, f), (1, last, t)):
                for k in range(1, near + 1):
                    i, j = here + step * k, other + step * k
                    if not (0 <= i < len(some) and 0 <= j < len(there)) or some[i] != there[j]:
                        break
                    gone.add(at[i])
        keep, last = [], False
        for i, x in enumerate(every):
            last = i in gone if i in at else last
            if not last:
                keep.append(x)
        out[doc_id] = "" if gone and len(gone) == len(at) else "\n".join(keep)
    return out


def symbol_grams(text):
    """The four-symbol number that ends at each symbol of a text, by the classes of the quality model."""
    out = []
    for c in text or "":
        if c in " \t\n\v\f\r":
            k = 0
        elif c.isascii() and c.isalpha():
            k = ord(c.lower()) - 96
        elif c.isascii() and c.isdigit():
            k = 27
        elif c in ".,;:!?'\"()-":
            k = 28
        elif c.isascii():
            k = 29
        else:
            k = 30 if ord(c) < 0x100 else 31
        if k or not out or out[-1]:
            out.append(k)
    flat = [0, 0, 0, *out, 0]
    return [sum(s << 5 * (3 - j) for j, s in enumerate(flat[i - 3 : i + 1])) for i in range(3, len(flat))]


def kneser_ney(counts, order=4, bits=5):
    """Modified Kneser-Ney by definition: n-gram counts of the full order; gives a function of an n-gram."""
    levels = {order: {tuple(g >> bits * (order - 1 - j) & 31 for j in range(order)): n for g, n in counts.items()}}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(k):
        n = Counter(levels[k].values())
        if min(n[1], n[2], n[3], n[4]) == 0:
            return lambda c: 0.5 if c else 0.0
        y = n[1] / (n[1] + 2 * n[2])
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    rules = {k: discount(k) for k in levels}

    def p(g):
        if not g:
            return 1 / 32
        level, rule = levels[len(g)], rules[len(g)]
        after = [n for h, n in level.items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        c = level.get(g, 0)
        return (c - rule(c)) / sum(after) + sum(map(rule, after)) / sum(after) * p(g[1:])

    return lambda gram: p(tuple(gram >> bits * (order - 1 - j) & 31 for j in range(order)))
