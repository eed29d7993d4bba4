"""A small documents table of awkward rows, and brute-force forms of what the operators should return."""

import collections
import hashlib
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, h string, key string"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
NEAR = " ".join([*(f"common{i}" for i in range(60))])
TEXTS = [
    (0, BASE, "en", "a"), (1, BASE, "en", "a"), (2, BASE.upper(), "en", None), (3, None, None, "b"), (4, "", "en", "b"),
    (5, "   \n\t ", "de", "b"), (6, "one two three", "en", "c"), (7, "One two three", "en", "c"), (8, "12 34 ?!", None, "a"),
    (9, LONG, "en", "a"), (10, LONG + " tail", "en", "a"), (11, NEAR, "fr", "z"), (12, NEAR.replace("common59", "other"), "fr", "z"),
    (13, NEAR.replace("common30", "changed"), "fr", "z"), (14, "éàü ñandú straße " * 8, "de", "c"), (20, "x", "en", "c"),
    (31, "mail bob.smith@mail.example.org, ip 10.0.0.255 and 1.2.3.400, card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (415) 555-0100 x", "en", "a"),
    (32, "a@b.c@d.e 1.2.3.4.5.6.7.8 +12 ++4930123456789 @@ x@y", "en", "a"), (33, "line shared by at least three documents\nown line\n  LINE shared by at least three documents \n", "en", "a"),
    (34, "line shared by at least three documents", "en", "a"), (35, "\nline shared by at least three documents\t\nline shared by at least three documents", "en", "b"), (36, "café line of twenty cp\ncafé line of twenty cp\r", "en", "b"),
    (40, BASE, "en", "a"), (41, None, "en", None),
]


def rows(repeat: bool = True):
    out = [(d, t, lang, s, len(t or ""), "s", "x", "h", "k") for d, t, lang, s in TEXTS]
    return out + ([out[0]] if repeat else [])


def table(spark, repeat: bool = True):
    return spark.createDataFrame(rows(repeat), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def shingles(text, lower=True):
    w = WORDS.findall((text or "").translate(LOWER) if lower else text or "")
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(docs):
    """doc_id -> (n_shingles, component) for (doc_id, text) rows, comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def lines(docs, shortest=20, least=3):
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")
    keys = {d: [(x, strip.sub("", x).translate(LOWER)) for x in (t or "").split("\n")] for d, t in docs}
    holds = collections.defaultdict(set)
    for d, own in keys.items():
        for _, k in own:
            if len(k) >= shortest:
                holds[k].add(d)
    out = {}
    for d, own in keys.items():
        kept = [x for x, k in own if not (len(k) >= shortest and len(holds[k]) >= least and max(holds[k]) != d)]
        out[d] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    return out


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(s[::-1])) % 10 == 0


def spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in kinds.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def targets(sizes):
    """source -> target from source -> size, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, rest, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def windows(docs, items):
    """doc_id -> (words, hits, item ids) by comparing words."""
    at = collections.defaultdict(set)
    sizes = set()
    for name, text in items:
        w = TOKENS.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        if n:
            sizes.add(n)
            for i in range(len(w) - n + 1):
                at[tuple(w[i : i + n])].add(name)
    out = {}
    for d, text in docs:
        w = TOKENS.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := at.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out[d] = (len(w), len(hit), sorted(str(x) for x in names if x is not None))
    return out
