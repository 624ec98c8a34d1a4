"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def pii(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    found.sort()
    return Counter(f[3] for f in found), ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, fps, most=4):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = list(zip(keys, fps))
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= most:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in keys}


def align(item, passage):
    prev, best = [0] * (len(passage) + 1), 0
    for w in item:
        row = [0]
        for j, x in enumerate(passage):
            row.append(max(0, prev[j] + (2 if x == w else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def targets(sizes, most=3):
    """sizes: source (or None) to words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


def pagerank(links, seeds, damping, rounds=400):
    out = defaultdict(float)
    for a, _, w in links:
        out[a] += w
    reached = {}
    for _ in range(rounds):
        score = defaultdict(float)
        for k, v in seeds.items():
            score[k] += (1 - damping) * v
        for k, v in reached.items():
            score[k] += v
        reached = defaultdict(float)
        for a, b, w in links:
            reached[b] += damping * score[a] * w / out[a]
    return dict(reached)


def secret_features(value, before, after, path, words, patterns):
    """patterns: the fixed patterns of the operator by name; words: the dictionary."""
    n = len(value)
    kind = "".join("d" if c in "0123456789" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "o" for c in value)
    has = lambda name, text: float(re.search(patterns[name], text) is not None)
    out = {
        "length": float(n), "digits": kind.count("d") / n, "uppers": kind.count("u") / n, "lowers": kind.count("l") / n, "signs": kind.count("o") / n, "distinct": len(set(value)) / n,
        "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value))), "coverage": sum(len(w) for w in re.findall("[a-z]{3,}", value.lower()) if w in words) / n, "odd_path": has("odd", path),
        "keyword": has("key", before), "assigned": float(bool(re.search("[=:]\\s*[\"']?$", before))), "quoted": float(before[-1:] in ("'", '"') and before != ""),
        "placeholder": max(has("placeholder", value), has("placeholder", before), has("placeholder", after)), "numeric": float(bool(re.fullmatch("[0-9-]+", value))), "known_prefix": has("prefix", value),
        "identifier": has("identifier", before), "keyword_after": has("key", after), "near_known": float(sum(w in words for w in re.findall(r"[^\W\d_]{3,}", f"{before} {after}".lower()))),
    }
    for x in "dulo":
        for y in "dulo":
            out[f"from_{x}_{y}"] = sum(a == x and b == y for a, b in zip(kind, kind[1:])) / max(n - 1, 1)
    return out


def beside(text, start, end, near):
    """The words on both sides of a value."""
    return " ".join(text[:start].split(" ")[-near - 1 :]), " ".join(text[end:].split(" ")[: near + 1])


def disclosing(texts, alpha=1.1, remove=0.999, level=0.05):
    """Terms that disclose an e-mail address or its domain, for distinct texts no two of which are copies: term to (kind, removed)."""
    mail = re.compile(PATTERNS[0][1])
    words = [set(re.findall(r"[^\W\d_]{3,}", mail.sub(" ", t).lower())) for t in texts]
    anywhere = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in texts]
    entities = [{e for m in mail.finditer(t) for e in (m[0], "group " + m[0][m[0].index("@") :])} for t in texts]
    total, tested = len(texts), sum(len(e) * len(w) for e, w in zip(entities, words))
    n_entity, n_both, n_term = Counter(e for s in entities for e in s), Counter((e, t) for s, w in zip(entities, words) for e in s for t in w), Counter(t for w in anywhere for t in w)
    out = {}
    for (e, t), both in n_both.items():
        ic, pmi = math.log2(total / n_entity[e]), math.log2(total * both / (n_entity[e] * n_term[t]))
        a, q = both / n_entity[e], n_term[t] / total
        apart = a * math.log(a / q) + ((1 - a) * math.log((1 - a) / (1 - q)) if a < 1 and q < 1 else 0)
        if ic > 0 and pmi >= ic / alpha - 1e-9 and math.log(tested) - n_entity[e] * apart <= math.log(level):
            out[t] = max(out.get(t, 0), pmi / ic)
    return {t: (0, told >= remove) for t, told in out.items()}


def rank_profile(text, most):
    """The most frequent letter n-grams of one to three characters, words padded with one space, ties by code points."""
    spaced = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()).strip(" ")) + " "
    if not spaced.strip():
        return []
    grams = Counter(spaced[i : i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1) if spaced[i : i + n].strip(" "))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(grams, key=lambda g: (-grams[g], code(g)))[:most]


def language(text, profiles, length):
    """(language, score) by out-of-place distance; profiles: language to its n-grams by rank."""
    own = rank_profile(text or "", length)
    if not own:
        return "und", 0.0
    far = {name: sum(abs(ranked.index(g) - k) if g in ranked else length for k, g in enumerate(own)) for name, ranked in sorted(profiles.items())}
    best = min(far, key=far.get)
    return best, 1 - far[best] / (length * len(own))
