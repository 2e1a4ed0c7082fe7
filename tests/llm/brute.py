"""Plain Python versions of the operators' contracts."""

import hashlib
import itertools
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def url_rule(url, rules):
    host, path = url_parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def chat(rows):
    """rows: (role, text) by turn."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def fingerprint(text, shingle=3):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=2):
    """id -> smallest id reachable over links within the radius; fps: id -> fingerprint."""
    at = {i: i for i in fps}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i in ids}


def licenses(text, base):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    seq = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in base.items() for i in range(len(seq)) if seq[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(seq), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    """(start, kind, end) of the contract's base spans; linear forms of its patterns."""
    text = text or ""
    found = []

    def take(kind, pattern, ok):
        found.extend((m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if ok(m.group()))

    digits = lambda x: re.sub("[^0-9]", "", x)
    take(0, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+", lambda m: True) if len(text) < 50_000 else take(0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+", lambda m: True)
    take(1, r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(x) <= 255 for x in m.split(".")))
    take(2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)))
    take(3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)
    return found


def best_place(item, text):
    """Fewest edits between the item and any region of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def patterns(texts, rounds, min_seeds, min_score):
    """Pattern to score, for texts of plain words, addresses (the seeds) and numbers of seven digits."""
    edges, totals = Counter(), Counter()
    for t in texts:
        w = t.split()
        for i, x in enumerate(w):
            totals[x] += 1
            totals[" ".join(w[i : i + 2])] += i + 1 < len(w)
            if "@" in x or len(x) >= 5:
                # words between this mention and the ones beside it
                before, after = w[:i], w[i + 1 :]
                k = next((k for k, y in enumerate(reversed(before)) if any(c.isdigit() for c in y)), len(before))
                before = before[len(before) - k :]
                after = after[: next((k for k, y in enumerate(after) if any(c.isdigit() for c in y)), len(after))]
                beside = {("L", *before[-1:]), ("L", *before[-2:]), ("R", *after[:1]), ("R", *after[:2])}
                for side, *near in beside:
                    if near:
                        edges[f"{side} {' '.join(near)}", x] += 1
    seeds = Counter(p for p, x in edges if "@" in x)
    score = {x: float("@" in x) for _, x in edges}
    hopeful = {p for p in seeds if seeds[p] >= min_seeds and sum(n for (q, _), n in edges.items() if q == p) >= min_score * totals[p[2:]]}
    edges = {k: n for k, n in edges.items() if k[0] in hopeful}
    rate = lambda p: min(1.0, sum(n * score[x] for (q, x), n in edges.items() if q == p) / totals[p[2:]])
    for _ in range(rounds):
        now = {p: rate(p) for p in hopeful}
        for x in {x for _, x in edges if "@" not in x}:
            rest = 1.0
            for p, y in edges:
                rest *= 1 - min(now[p], 0.999) if y == x else 1
            score[x] = 1 - rest
    share = lambda p: sum("@" in x for q, x in edges if q == p) / sum(q == p for q, _ in edges)
    return {p: rate(p) for p in hopeful if rate(p) >= min_score and share(p) >= 0.5}


def rules(rows, params):
    """Antecedent to (confidence, support) of (tokens, label) rows, by counting every set of tokens."""
    total, blocked = len(rows), sum(x == "block" for _, x in rows)
    least = max(params.MIN_URLS, math.ceil(params.MIN_SUPPORT * total))
    count = {}
    for k in range(1, params.MAX_ANTECEDENT + 1):
        for a in itertools.combinations(sorted({t for own, _ in rows for t in own}), k):
            holds = [x for own, x in rows if set(a) <= set(own)]
            if holds.count("block") >= least:
                count[a] = (holds.count("block"), len(holds))
    found = {}
    for a, (hits, n) in count.items():
        chi = total * (hits * total - n * blocked) ** 2 / (n * (total - n) * blocked * (total - blocked)) if n < total else 0
        if hits / n >= params.MIN_CONFIDENCE and hits / n >= params.MIN_LIFT * blocked / total and chi >= params.critical_value(len(count)):
            found[a] = (hits / n, hits / total)
    keep = {a for a in found if not any(set(b) < set(a) and found[b][0] >= found[a][0] for b in found)}
    return {a: tuple(round(x, 9) for x in found[a]) for a in keep}
