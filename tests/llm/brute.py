"""Plain Python versions of the contracts, for small tables: rows in, dicts by id out."""

import base64
import hashlib
import re

import xxhash

from dataprobe.llm import licenses

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = BLANK.findall(text)
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n = len(words)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def suffix(rows):
    """rows (doc_id, text) -> {(doc_id, text): (n_bytes, n_removed, n_spans, sha)}."""
    first, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            x = b[i : i + 50]
            first[x] = min(first.get(x, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[d, t] = len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()
    return out


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(text, items):
    """items (item_id, text) -> (n_words, n_hit, n_items, sha, contaminated)."""
    own = words(text)
    hit, found = set(), set()
    for item, said in items:
        w = words(said)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def fingerprint(text, k=3):
    w = BLANK.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(len(w) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, bits=3):
    """{id: smallest id reachable} for [(id, fingerprint)]."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(prints):
        for j, y in prints[:n]:
            if bin(x ^ y).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licence(text):
    own = words(text)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(own) - len(p) + 1):
            if own[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def expression(tokens, allowed):
    """(labels, permitted) of the longest beginning that is an expression of known names, by recursive descent."""

    def any_of(i, word, inner):
        got = inner(i)
        while got and got[0] < len(own) and own[got[0]] == word and (more := inner(got[0] + 1)):
            got = more[0], got[1] | more[1], (got[2] or more[2]) if word == "or" else (got[2] and more[2])
        return got

    def single(i):
        if i < len(own) and own[i] == "(":
            got = any_of(i + 1, "or", conjunction)
            return (got[0] + 1, *got[1:]) if got and got[0] < len(own) and own[got[0]] == ")" else None
        label = licenses.label_of(own[i]) if i < len(own) else None
        if label is None:
            return None
        if own[i + 1 : i + 2] == ["with"] and set(own[i + 2 : i + 3]) & licenses.EXCEPTIONS:
            return i + 3, {f"{label} with {own[i + 2]}"}, label in allowed
        return i + 1, {label}, label in allowed

    def conjunction(i):
        return any_of(i, "and", single)

    for size in range(len(tokens), 0, -1):
        own = [t.lower() for t in tokens[:size]]
        got = any_of(0, "or", conjunction)
        if got and got[0] == size:
            return got[1:]
    return set(), False


def licence_labels(text):
    """(labels, score): phrases one by one, tags by a pattern on the text."""
    own, labels, score = " " + " ".join(words(text)) + " ", set(), 0.0
    for phrases, weight in ((licenses.MORE_PHRASES, 0.6), (licenses.BASE_PHRASES, 0.9)):
        for phrase, label in phrases.items():
            if f" {phrase} " in own:
                labels.add(label)
                score = weight
    for said in re.findall(r"(?i)(?<![a-z0-9])spdx[^a-z0-9\u0080-\U0010ffff]+license[^a-z0-9\u0080-\U0010ffff]+identifier:[ \t]*([^\r\n]*)", text or ""):
        found, _ = expression(re.findall(r"[()]|[A-Za-z0-9.+:-]+", said), frozenset())
        labels |= found
        score = 1.0 if found else max(score, 0.3 if re.search(r"^[^a-z0-9]*[a-z0-9]", said, re.I) else 0.0)
    return ",".join(sorted(labels)), score


def warc(pages):
    """pages (page_id, html) with distinct ids -> {page_id: (bytes, digest, type, refers)}."""
    last = {}
    for p, h in pages:
        last[h or ""] = max(last.get(h or "", p), p)
    out = {}
    for p, h in pages:
        b = (h or "").encode()
        other = last[h or ""]
        out[p] = len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if other == p else "revisit", None if other == p else other
    return out


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url(value):
    """(host, path, rule, verdict of the rule)."""
    if value is None or "://" not in value:
        return "", "", None, None
    rest = value.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def schedule(slots, blocks=None):
    """Earliest deadline first: {(source, turn): slot} for {source: slots} and as many blocks, by default a period's."""
    p, nxt, out, slot = sum(slots.values()), dict.fromkeys(slots, 0), {}, 0
    blocks = blocks or slots
    names = sorted(slots, key=lambda s: s or "")
    while len(out) < sum(blocks.values()):
        ready = [(-(-(nxt[s] + 1) * p // slots[s]), i) for i, s in enumerate(names) if nxt[s] < blocks[s] and nxt[s] * p // slots[s] <= slot]
        if ready:
            s = names[min(ready)[1]]
            out[s, nxt[s]] = slot
            nxt[s] += 1
        slot += 1
    return out
