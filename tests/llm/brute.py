"""Plain-Python versions of the operators' contracts, and frames with awkward rows."""

import hashlib
import re

import numpy as np
import xxhash

SMOKE = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark, sf_dir=SMOKE):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


# Columns that bear names the operators might use themselves.
CLASH = ["d", "h1", "h2", "key", "fp", "rep", "rank", "piece", "found", "marks", "kept", "hits", "items", "n_words",
         "score", "label", "ids", "decoded", "shard", "slot", "size", "host", "page", "cell", "kinds", "word", "pos",
         "component_id", "_text", "_id", "features", "cut"]


def frame(spark, rows, source="s"):
    """(doc_id, text) rows as a documents table with extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASH)
    full = [(i, t, "en", source, None if t is None else len(t), *["x"] * len(CLASH)) for i, t in rows]
    return spark.createDataFrame(full, schema)


def passage(word, n, start=0):
    return " ".join(f"{word}{i}" for i in range(start, start + n))


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, passage("a", 60)),
    (7, "pre " + passage("a", 60) + " post"), (8, passage("a", 60).upper()), (9, "same " * 50), (10, "same " * 50),
    (11, "naïve café — 東京 🙂 " * 8), (12, passage("b", 20)), (13, passage("b", 20)), (14, passage("b", 19)),
    (15, passage("long", 30_000)), (16, passage("long", 30_000, 7)), (17, "x" * 40_000), (18, "é" * 5_000),
    (19, "line\nline\n\nline"), (20, passage("a", 25, 10) + "\n" + passage("b", 20)),
]


def substring(docs, window=20):
    """doc_id → (words, removed, digest of the kept words)."""
    seen, out = set(), {}
    for i in sorted(docs):
        w = SPACE.findall(docs[i] or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def decontamination(docs, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    strings = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    out = {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in {len(s) for s in strings}:
            for k in range(len(w) - n + 1):
                own = strings.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def fingerprint(text):
    w = SPACE.findall((text or "").translate(FOLD))
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """id → smallest id reachable; linked(i, j) decides."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(ids)
    for a, i in enumerate(order):
        for j in order[a + 1:]:
            if linked(i, j):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def simhash(docs):
    fp = {i: fingerprint(t) for i, t in docs.items()}
    comp = components(list(docs), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    return {i: (f"{fp[i]:016x}", comp[i]) for i in docs}


def near_vectors(rows, least=0.93):
    """rows: (vec_id, vector, label) → vec_id → (links, component)."""
    def usable(v, label):
        if label is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        x = np.array(v, dtype=np.float64)
        return x / np.linalg.norm(x) if np.linalg.norm(x) > 0 else None

    unit = {i: usable(v, label) for i, v, label in rows}
    label = {i: lab for i, _, lab in rows}

    def linked(i, j):
        a, b = unit[i], unit[j]
        return (a is not None and b is not None and label[i] == label[j] and len(a) == len(b)
                and float(a @ b) >= least)

    comp = components(list(unit), linked)
    return {i: (sum(linked(i, j) for j in unit if j != i), comp[i]) for i in unit}


SECRETS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(SECRETS)
                  for m in p.finditer(text or "") if len(m[group]) >= least)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def personal(text):
    """Base spans: (kind, start, end) by kind, then start."""
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in re.finditer(p, text) if ok(m[0])]
