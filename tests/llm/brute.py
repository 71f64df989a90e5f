"""Plain versions of the ten operators on lists of rows (doc_id, text, lang, source)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else bytes(text)).hexdigest()


def crc_ids(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def secrets(text: str):
    rules = [(0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), (1, re.compile("AKIA[A-Z0-9]+"), 0, 18), (2, re.compile("[0-9a-f]+"), 0, 16)]
    return sorted((m.start(), k, m.end()) for k, rx, g, least in rules for m in rx.finditer(text) if len(m[g]) >= least)


def substring_cuts(rows, width=100):
    """{text: (removed, spans, kept)} in order of doc_id."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        if (doc, raw) in out:
            continue
        cover, end = bytearray(len(raw)), 0
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                cover[max(i, end) : i + width] = b"\x01" * (i + width - max(i, end))
                end = i + width
            else:
                seen.add(w)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[doc, raw] = (len(raw), sum(cover), spans, sha(bytes(b for b, c in zip(raw, cover) if not c)))
    return out


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Each row's component, by the number of one of its rows; rows without words are alone."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def components(rows):
    of, least = groups(rows), {}
    for g, (doc, _) in zip(of, rows):
        least[g] = min(doc, least.get(g, doc))
    return [(doc, len(shingle_set(text)), least[g]) for g, (doc, text) in zip(of, rows)]


def assert_one_of_each(rows, kept):
    """Whole rows (doc_id, text, ...): kept holds one of each component's rows, that with its
    smallest id, and all rows without words, each as often as rows does."""
    from collections import Counter

    held, given = Counter(kept), Counter(rows)
    assert not held - given
    wordless = Counter({x: n for x, n in given.items() if not shingle_set(x[1])})
    assert Counter({x: n for x, n in held.items() if not shingle_set(x[1])}) == wordless
    group = {x[:2]: g for x, g in zip(rows, groups([x[:2] for x in rows]), strict=True)}
    least: dict = {}
    for x in rows:
        least[group[x[:2]]] = min(x[0], least.get(group[x[:2]], x[0]))
    with_words = [x for x in kept if shingle_set(x[1])]
    assert sorted(group[x[:2]] for x in with_words) == sorted({group[x[:2]] for x in rows if shingle_set(x[1])})
    assert all(least[group[x[:2]]] == x[0] for x in with_words)


def line_cuts(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), ())) >= 5 and doc != max(docs[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
