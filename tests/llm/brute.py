"""Plain versions of the text operators for small tables, without Spark and without cleverness."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring_dedup(rows, window=35):
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(rows, items, window=10):
    def words(t):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k:k + window])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def suffix_dedup(rows, width=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - width + 1):
            s = t[k:k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k:k + width]] < i:
                gone[k:k + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def exact_dedup(rows):
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[norm[k]].append(i)
    return [(i, min(groups[norm[k]]), len(groups[norm[k]]), i == min(groups[norm[k]]), sha(norm[k].encode()))
            for k, (i, _) in enumerate(rows)]


def simhash(rows, width=4, distance=4):
    prints = []
    for i, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        grams = [b" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= distance:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [(i, format(x, "016x"), find(i)) for i, x in prints]


def crc(i):
    return zlib.crc32(str(i).encode())


def line_dedup(rows, similarity=0.8):
    lines, per_doc = {}, {}
    for i, t in rows:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        per_doc[i] = [frozenset(WORD.findall(x)) for x in low.split(b"\n")]
        for k, s in enumerate(per_doc[i]):
            if s:
                lines.setdefault(s, []).append((i, k))
    sets = list(lines)
    linked = {s: [] for s in sets}
    holding = defaultdict(list)
    for k, s in enumerate(sets):
        near = Counter(j for w in s for j in holding[w])
        for j, both in near.items():
            if both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                linked[s].append(sets[j])
                linked[sets[j]].append(s)
        for w in s:
            holding[w].append(k)
    earliest = {s: min(min(lines[x]) for x in [s, *linked[s]]) for s in sets}
    classes = defaultdict(list)
    for i, sets_of in per_doc.items():
        classes[tuple(sets_of)].append(i)
    out = []
    for i, t in rows:
        gone = {k for k, s in enumerate(per_doc[i]) if s and earliest[s] < (i, k)}
        kept = b"\n".join(x for k, x in enumerate((t or "").encode().split(b"\n")) if k not in gone)
        out.append((i, min(classes[tuple(per_doc[i])]), sum(map(bool, per_doc[i])), len(gone), sum(len(linked[s]) for s in per_doc[i] if s), sha(kept)))
    return out


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def manifest(rows, fanout=8):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode())

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + fanout]).encode()) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // fanout * fanout
            yield "".join(nodes[a:i]), "".join(nodes[i + 1:a + fanout])
            i //= fanout

    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        low = text
        if tampered(doc_id) and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees[lang].append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, low))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[lang] = levels([r[1] for r in trees[lang]])
    top = levels([built[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (doc_id, own, other) in enumerate(trees[lang]):
            beside = [*path(built[lang], i), *path(top, k)]
            folded = other
            for before, after in beside:
                folded = sha((before + folded + after).encode())
            out.append((doc_id, own, built[lang][-1][0], top[-1][0], sha("".join(b + a for b, a in beside).encode()), folded, folded == top[-1][0]))
    return out


def encoded(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    return out


def joined(piece, ranks):
    """Byte-pair joins one after another; a piece that is a token is that token."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def codes(rows, parts=8, entries=16, rounds=6):
    import math

    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]]
    w = len(first[0]) // parts
    books = [[v[p * w:p * w + w] for v in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            met = defaultdict(list)
            for _, v, _ in kept:
                met[near(v[p * w:p * w + w], book)[1]].append(v[p * w:p * w + w])
            new.append([[sum(c) // len(met[e]) for c in zip(*met[e])] if e in met else entry for e, entry in enumerate(book)])
        books = new
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(v[p * w:p * w + w], book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    digest = sha(",".join(str(x) for book in books for entry in book for x in entry).encode())
    return [(i, code, error, total[label], digest) for i, code, error, label in out]
