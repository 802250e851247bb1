"""Plain versions of the operators, written from their contracts alone."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def components(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def fingerprint(text):
    ws = words((text or "").translate(UPPER))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(rows):
    """doc_id -> (fingerprint, component) of (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    fps = [fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    return {rows[i][0]: (f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(components(len(rows), linked))}


def without_repeats(rows, width=13):
    """doc_id -> (n_words, n_removed, kept words) of (doc_id, text) with distinct ids."""
    first = {}
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        ws, gone = words(t), set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(ws), len(gone), [w for i, w in enumerate(ws) if i not in gone])
    return out


def measures(text):
    """(words, their characters, symbols, lines with a word, those equal to an earlier one, words in repeated windows)."""
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    repeated = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), repeated


def quality(rows):
    """doc_id -> (base_failed, kept) of (doc_id, text, lang, source): fences at three quartile distances of the groups' values,
    which count by their five leading bits; small groups use their language's values, and small languages none."""
    least, slack = 30, {"symbols": 200, "dup_lines": 400, "word_length": 150}
    known, groups = {}, {}
    for d, t, lang, source in rows:
        n, chars, symbols, lines, dup, rep = measures(t)
        failed = n < 10 or 100 * rep > 20 * n
        values = {"symbols": 1000 * symbols // max(n, 1), "dup_lines": 1000 * dup // max(lines, 1), "word_length": 100 * chars // max(n, 1)}
        known[d] = (failed, values, lang, source)
        if not failed:
            for key in ((lang, source), (lang,)):
                groups.setdefault(key, []).append(values)

    def fence(lang, source, metric):
        own = groups.get((lang, source), [])
        own = own if len(own) >= least or not own else groups.get((lang,), [])
        if len(own) < least:
            return None
        short = lambda v: v >> max(v.bit_length() - 5, 0) << max(v.bit_length() - 5, 0)
        ordered = sorted(short(v[metric]) for v in own)
        q1, q3 = (next(x for i, x in enumerate(ordered) if 4 * (i + 1) >= q * len(ordered)) for q in (1, 3))
        return q1 - 3 * (q3 - q1) - slack[metric], q3 + 3 * (q3 - q1) + slack[metric]

    out = {}
    for d, (failed, values, lang, source) in known.items():
        fine = not failed
        for metric, v in values.items():
            bounds = fence(lang, source, metric)
            if fine and bounds:
                fine = v <= bounds[1] and (metric != "word_length" or v >= bounds[0])
        out[d] = (failed, fine)
    return out
