"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import defaultdict

import xxhash


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    """{key: smallest reachable key} of a small set of keys; linked(a, b) says whether two are."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def near(docs):
    """{doc_id: (fingerprint, component)} of {doc_id: text}."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    roots = components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    return {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated)."""
    own = words(text)
    hit, found = set(), set()
    for item, question in items:
        theirs = words(question)
        windows = {tuple(theirs[i : i + 10]) for i in range(len(theirs) - 9)} or ({tuple(theirs)} if theirs else set())
        for w in windows:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text):
    """The base spans, ordered."""
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


# (role, pattern) of the weak parts, and what each role needs beside it.
WEAK = {
    "key": ("secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}"),
    "account": ("id", r"(?<![A-Za-z0-9])(?i:client_id|account_id|user_id|username|login|access_key_id)[\"']? {0,4}[:=] {0,4}[\"']?[A-Za-z0-9_.@-]{4,}"),
    "mail": ("id", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "uuid": ("id", r"(?<![A-Za-z0-9-])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9-])"),
    "endpoint": ("endpoint", r"(?:https?|ftp|s3|jdbc:[a-z]{2,16}|mongodb|postgres|mysql|redis|amqp)://[A-Za-z0-9._:@/-]{4,}"),
    "address": ("endpoint", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9])"),
    "host": ("endpoint", r"(?<![A-Za-z0-9])(?i:host|hostname|server|endpoint|region)[\"']? {0,4}[:=] {0,4}[\"']?[A-Za-z0-9_.-]{4,}"),
}
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {k: r for k, (r, _) in WEAK.items()}
NEEDS = {"secret": {"id", "endpoint"}, "id": {"secret"}, "endpoint": {"secret"}}


def all_secrets(text, reach=400):
    """Base spans, and weak ones with a complementary part in reach, by start, kind and end."""
    base = base_secrets(text)
    weak = []
    for kind, (_, pattern) in WEAK.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            if kind != "key" or all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
                weak.append((kind, m.start(), m.end()))
    kinds, linked = ["assign", "access", "hex", *WEAK], []
    for kind, start, end in weak:
        for other, a, b in base + weak:
            apart = not (a < end and b > start)
            if apart and ROLE[other] in NEEDS[ROLE[kind]] and a <= end + reach and b >= start - reach:
                linked.append((kind, start, end))
                break
    return sorted(base + linked, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def shards(rows, n=24, seed_hash=None):
    """[(id, source, size, crc, shard, slot)] of [(id, text, source)]."""
    by_source = defaultdict(list)
    for i, text, source in rows:
        data = (text or "").encode()
        by_source[source].append((seed_hash(i), i, zlib.crc32(data), len(data) + 8))
    dealt = []
    for source, own in by_source.items():
        for rank, (_, i, crc, size) in enumerate(sorted(own)):
            dealt.append(((2 * rank + 1) / (2.0 * len(own)), source or "", i, source, size, crc))
    dealt.sort(key=lambda r: (r[0], r[1]))
    total, out, slots = len(dealt), [], defaultdict(int)
    for place, (_, _, i, source, size, crc) in enumerate(dealt):
        shard = place * n // total
        out.append((i, source, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney over code points, from dictionaries."""

    def __init__(self, texts, order):
        self.order, counts = order, defaultdict(int)
        for t in texts:
            padded = "\x01" * (order - 1) + t.replace("\x00", "\x01")
            for i in range(len(padded) - order + 1):
                counts[padded[i : i + order]] += 1
        self.orders = {order: dict(counts)}
        for k in range(order - 1, 0, -1):
            lower = defaultdict(int)
            for g in self.orders[k + 1]:
                lower[g[1:]] += 1
            self.orders[k] = dict(lower)
        self.cuts, self.contexts = {}, {}
        for k, table in self.orders.items():
            n = [sum(v == x for v in table.values()) for x in range(5)]
            if min(n[1:]) == 0:
                self.cuts[k] = (0.5, 1.0, 1.5)
            else:
                y = n[1] / (n[1] + 2 * n[2])
                self.cuts[k] = tuple(min(max(x - (x + 1) * y * n[x + 1] / n[x], 0.05 * x), x) for x in (1, 2, 3))
            stats = defaultdict(lambda: [0, 0.0])
            for g, v in table.items():
                stats[g[:-1]][0] += v
                stats[g[:-1]][1] += self.cuts[k][min(v, 3) - 1]
            self.contexts[k] = stats

    def prob(self, gram):
        if not gram:
            return 1 / 0x110000
        k = len(gram)
        if gram[:-1] not in self.contexts[k]:
            return self.prob(gram[1:])
        total, taken = self.contexts[k][gram[:-1]]
        n = self.orders[k].get(gram, 0)
        own = (n - self.cuts[k][min(n, 3) - 1]) / total if n else 0.0
        return own + taken / total * self.prob(gram[1:])

    def cost(self, text):
        padded = "\x01" * (self.order - 1) + text.replace("\x00", "\x01")
        return -sum(math.log(self.prob(padded[i : i + self.order])) for i in range(len(padded) - self.order + 1))


def quality(rows, trusted, order, quantile, prior):
    """{id: (n, perplexity, score, threshold)} of rows (id, text, lang)."""
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), 5) & 1
    texts = [t for i, t, _ in rows if i in trusted and t]
    whole = KneserNey(texts, order)
    parts = [KneserNey([t for t in texts if half(t) == h], order) for h in (0, 1)]
    held = [(lang or "", len(t), parts[1 - half(t)].cost(t)) for i, t, lang in rows if i in trusted and t]
    of = lambda rows: sum(c for *_, c in rows) / sum(n for _, n, _ in rows)
    means = {lang: of([h for h in held if h[0] == lang]) for lang in {h[0] for h in held}}
    score = lambda n, c, lang: math.floor(100 * (c - n * means.get(lang, of(held))) / math.sqrt(n + prior))
    limit = lambda found: max(0, sorted(found)[math.ceil(len(found) * quantile) - 1])
    by_lang = defaultdict(list)
    for lang, n, c in held:
        by_lang[lang].append(score(n, c, lang))
    default = limit([x for found in by_lang.values() for x in found])
    out = {}
    for i, t, lang in rows:
        n, c, lang = len(t or ""), whole.cost(t or ""), lang or ""
        out[i] = (n, math.exp(c / max(n, 1)), score(n, c, lang), limit(by_lang[lang]) if lang in by_lang else default)
    return out
