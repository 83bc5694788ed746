"""Brute-force versions of the operators, in plain Python, and documents that are awkward on purpose."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "uid long, node long, rep long, n long, key string, digest string, score double, keep_id long, kept boolean, _row string, _text string, _key string, _id long, votes string"
)
EXTRA = 14


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def words(text):
    return WORD.findall(lower(text))


VOCABULARY = "the of stone river walks slowly under green hill and café naïve größe 12 x".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward():
    rng = random.Random(5)
    base = sentence(rng, 80)
    long = sentence(rng, 30_000)
    rows = [
        (1, base), (1, base), (2, base.upper()), (3, base + " once"), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, None),
        (None, "a text of no id"), (7, "three short words"), (8, "Three, SHORT words!"), (9, long), (10, long[:-3] + "end"),
        (11, "!!! *** ..."), (12, "x" * 50_000), (13, "漢字 かな ﬁ é! ≠ \u00a0 \u3000 z"), (14, "it's 'a! 's!' don''t <|endoftext|>"),
        (15, sentence(rng, 40)), (16, sentence(rng, 200)), (17, "\x00\x01 \x1c a\x1cb"), (18, "AÀÉ aàé Été été"),
    ]
    return [(i, t, "en", f"src{k % 3}" if k % 4 else None, None if t is None else len(t)) + (None,) * EXTRA for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def small(spark, pairs):
    return frame(spark, [(i, t, "en", "s", None) + (None,) * EXTRA for i, t in pairs])


def shingle_set(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))


def jaccard_links(texts, similarity=0.8):
    """Pairs of row numbers."""
    sets = [shingle_set(t) for t in texts]
    out = []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    out.append((a, b))
    return out


def component_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def contamination(texts, items, width=13):
    """(n_words, n_hit, items) of each text."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                key = tuple(w[s : s + m])
                if key in windows:
                    hit.update(range(s, s + m))
                    found |= windows[key]
        out.append((len(w), len(hit), found))
    return out


def first_fit(lengths, size):
    bins, out = [], []
    for n in lengths:
        for i, filled in enumerate(bins):
            if filled + n <= size:
                out.append((i, filled))
                bins[i] += n
                break
        else:
            out.append((len(bins), 0))
            bins.append(n)
    return out


def base_scores(rows):
    """doc row -> (held out, tokens, known, base score); rows are (id, text)."""
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    tokens = [TOKEN.findall(lower(t)) + ["\x00end"] for _, t in rows]
    counts = collections.Counter(w for h, t in zip(held, tokens) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return total, [
        (h, len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
        for h, t in zip(held, tokens)
    ]


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mixture(rows, weights=(5, 2, 1), share=1.5, limit=2):
    """Target of each source; rows are (source, size). Shares what is above the limits again and again."""
    sizes = collections.Counter()
    for source, size in rows:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, budget, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = budget / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > limit * sizes[s]}
        for s in above or free:
            target[s] = limit * sizes[s] if above else weight[s] * level
        budget -= sum(target[s] for s in above)
        free = free - above if above else set()
    return sizes, target


def alignment(text, a, b, a_bytes, b_bytes):
    """(ids of A, ids of B, groups) of a whole text by two encoders, or None; groups are pairs of id lists."""
    if not text:
        return None
    want = (" " + text).encode()
    x, y = a(" " + text), b(text)
    if b"".join(map(a_bytes, x)) != want or b"".join(map(b_bytes, y)) != want:
        return None
    groups, i, j, p, q, left, right = [], 0, 0, 0, 0, [], []
    while i < len(x) or j < len(y):
        if p <= q and i < len(x):
            p += len(a_bytes(x[i]))
            left.append(x[i])
            i += 1
        else:
            q += len(b_bytes(y[j]))
            right.append(y[j])
            j += 1
        if p == q:
            groups.append((left, right))
            left, right = [], []
    return x, y, groups


def alignment_rows(texts, *encoders):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    found = [alignment(t, *encoders) for t in texts]
    links = [collections.Counter((x, y) for left, right in (f[2] if f else []) for x in left for y in right) for f in found]
    docs = collections.Counter(pair for held in links for pair in held)
    best = collections.Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for f, held in zip(found, links):
        x, y, groups = f or ([], [], [])
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((
            len(x), len(y), len(groups), sum(held.values()), sum(n for pair, n in held.items() if docs[pair] == best[pair[0]]),
            sum(n * docs[pair] for pair, n in held.items()), hashlib.sha256(text.encode()).hexdigest() if f else "",
        ))
    return out


def rebuilt(rows):
    """conv_id -> turns, from (conv_id, turn, role, text); the first turns come from the first conversation of its hundred."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(role, text) for *_, role, text in sorted(found)] for c, found in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def trie(sequences):
    """The rows of the prefix trie of conv_id -> turns, as tuples in the order of the query's columns."""
    members = collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = collections.Counter(k[:-1] for k in members if k), []
    leaves, saved = collections.Counter(), collections.Counter()
    for k, found in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(found) - 1) * len(k[-1][1]) if k else 0
    for k, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(sequences[c]) == len(k))
        out.append((
            min(found), len(k), min(members[k[:-1]]) if k else None, len(found), children[k], leaves[k], saved[k],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0]))
