"""Small tables of awkward rows, and plain versions of the operators to compare with."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, id long, digest string, slot int, "
    "node string, row string, size string, first string, label string, __id string"
)


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def documents():
    """(doc_id, text): missing, empty, blank, short, long and periodic texts, copies, repeated
    rows, near copies, shared passages, missing ids."""
    shared = words("shared", 70)
    base = words("base", 200)
    near = base.replace("base7 ", "other ")
    nearer = near.replace("base150 ", "third ")
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\r\n "),
        (4, "That it."),
        (5, "that IT."),
        (6, "a b c"),
        (7, words("long", 9000) + " " + shared),
        (8, "tick " * 300),
        (9, f"{words('x', 50)} {shared} {words('y', 50)}"),
        (10, f"{words('z', 40)}\n{shared}"),
        (11, f"{shared}, {words('é', 30)} \U0001f600 end"),
        (12, base),
        (13, base),
        (14, near),
        (15, nearer),
        (15, nearer),
        (16, words("p", 35)),
        (17, "q " + words("p", 35)),
        (18, words("p", 34)),
        (None, "no number " + words("n", 60)),
        (None, "no number " + words("n", 60)),
        (19, None),
        (-5, base.upper()),
        (20, "x" * 2000),
        (21, "\x00 nul " + "ab" * 500),
    ]
    return rows


def frame(spark, rows=None):
    """The rows with columns whose names the operators use themselves."""
    rows = documents() if rows is None else rows
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, 7, "d", 1, "n", "r", "z", "f", "l", "i") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df, *columns):
    """Rows as a multiset."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def brute_windows(rows, length):
    """(id, units, removed, kept) by counting every window of words."""
    count = Counter()
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if count[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return Counter(out)


def brute_bytes(rows, length):
    """(id, bytes, removed, spans, kept) by counting every string of the length."""
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return Counter(out)


FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, n, num, den):
    """(id, set size, smallest id reachable) by counting common n-grams of all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j < k)
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(text):
    """Valid spans (start, kind number, end, kind) of a text."""
    found = []
    for order, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return sorted(found)
