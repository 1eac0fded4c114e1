"""URL filters: rules by host and path, and a logistic regression where no rule fits.

The regression's features are hashed character n-grams of host and path; it is trained on the
driver from a small labelled table of URLs (at most `MAX_LABELLED` rows, the documented bound of
the sample), and its weights are one array of 2**BITS numbers, whatever the corpus.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the
verdict that the regression gives an empty url; repeated rows are judged each for itself; an
empty table gives an empty table. Only the id and url columns are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZES = (3, 4, 5)
MAX_LABELLED = 10_000

#: (verdict, host, path) of the contract's rules (fixed values).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_GOOD_WORDS = [
    "university", "library", "school", "science", "museum", "daily", "weather", "garden", "recipe", "travel", "health", "clinic",
    "city", "council", "history", "archive", "journal", "research", "course", "lecture", "music", "theatre", "football", "cycling",
    "camera", "physics", "biology", "chemistry", "parliament", "railway", "airport", "bakery", "poetry", "language", "nature",
    "forest", "river", "weekly", "hospital", "software", "standards", "mountain", "village", "orchestra", "gallery", "academy",
]
_BAD_WORDS = [
    "casino", "poker", "slots", "roulette", "betting", "bets", "jackpot", "lottery", "pills", "meds", "viagra", "steroids", "loans",
    "payday", "replica", "porn", "xxx", "adult", "escorts", "nudes", "camgirls", "warez", "keygen", "cracks", "torrents", "malware",
    "phishing", "spam", "clickbait", "backlinks", "followers", "giveaway", "prizes", "doubler", "ads", "popups", "banners", "tracker",
]
# Words that stand beside others, on either side.
_GOOD_BESIDE = ["national", "open", "public", "royal", "local", "modern", "central", "online", "world", "review", "news", "centre"]
_BAD_BESIDE = ["best", "hot", "instant", "extra", "secret", "vip", "lucky", "buy", "bonus", "discount", "shop", "zone"]
_GOOD_PATHS = ["/about", "/contact.html", "/articles/{n}", "/docs/guide-{n}", "/research/papers/{n}.pdf", "/archive/2019/{n}", "/en/{n}.html", "/news/{n}/", "/course/{n}/notes", ""]
_BAD_PATHS = [
    "/buy-now", "/free-download/{n}.exe", "/bonus/claim", "/click?id={n}", "/out/redirect/{n}", "/xxx/{n}", "/win/{n}/prize", "/unsubscribe/{n}",
    "/order-pills/{n}", "/login/verify-account/{n}",
]
_FRONTS = ["", "www.", "blog.", "m.", "shop."]
_ENDINGS = ["test", "invalid", "org", "net", "info", "eu", "co.uk", "de"]
_SYLLABLES = [c + v + e for c in "bdfghklmnprstvwz" for v in "aeiou" for e in ("", "n", "r", "th")]


def labelled_urls(rows: int = 6_000, seed: int = 11) -> list[tuple[str, int]]:
    """The small table that the regression is trained from: (url, 1 to block).

    It is built by rule from words that are common in either kind of url: hosts of one or two words,
    or, for ordinary sites, of syllables that are no words; prefixes, endings and numbers are the same
    for both. A url is bad by its host, by its path, or by both.
    """
    import random

    rng = random.Random(seed)

    def two(words, beside):
        pair = [rng.choice(words), rng.choice(beside)] if rng.random() < 0.6 else [rng.choice(words)]
        rng.shuffle(pair)
        return rng.choice(["-", "", "."]).join(pair)

    def host(bad):
        if bad:
            name = two(_BAD_WORDS, _BAD_BESIDE + _GOOD_BESIDE + ["".join(rng.choices(_SYLLABLES, k=2))])
        elif rng.random() < 0.5:
            name = two(_GOOD_WORDS, _GOOD_BESIDE)
        else:
            name = "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4)))
        return f"{rng.choice(_FRONTS)}{name}.{rng.choice(_ENDINGS)}"

    def path(bad):
        return rng.choice(_BAD_PATHS if bad else _GOOD_PATHS).format(n=rng.randint(1, 99_999))

    table = []
    for i in range(rows):
        kind = i % 4  # half are good; of the others the host, the path or both are bad
        bad_host = kind == 1 or kind == 3 and rng.random() < 0.3
        bad_path = kind == 3 or kind == 1 and rng.random() < 0.3
        table.append((f"https://{host(bad_host)}{path(bad_path)}", int(bad_host or bad_path)))
    return table


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url, as the columns have them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[: min(ends, default=len(rest))]


def features(host: str, path: str) -> list[int]:
    """The places of a url's n-grams in the weights; the last one is the constant."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for size in SIZES:
            for i in range(len(text) - size + 1):
                found.add(zlib.crc32(f"{mark}{text[i : i + size]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1))
    return [*sorted(found), 1 << BITS]


def train(table: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4):
    """The weights of a logistic regression fitted by gradient steps scaled per feature."""
    import numpy as np

    if len(table) > MAX_LABELLED:
        raise ValueError(f"{len(table)} labelled urls; the table is held to {MAX_LABELLED}")
    rows = [features(*split_url(url)) for url, _ in table]
    at = np.concatenate([np.array(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.array([label for _, label in table], dtype=float)
    size = (1 << BITS) + 1
    weights, scale = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(of, weights[at], minlength=len(rows))))
        slope = np.bincount(at, (p - y)[of], minlength=size) / len(rows) + decay * weights
        scale += slope**2
        weights -= rate * slope / np.sqrt(scale)
    return weights


def probability(weights, host: str, path: str) -> float:
    """The probability that a url is to be blocked."""
    import math

    total = float(weights[features(host, path)].sum())
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def host_column(url: Column) -> Column:
    """After the first :// up to /, ? , # or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, table=None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row; score is the regression's probability to block."""
    import pyarrow as pa

    sent = pages.sparkSession.sparkContext.broadcast(train(table or labelled_urls()))
    url = F.col(url_col)
    split = pages.select(F.col(id_col).alias("id"), host_column(url).alias("host"), path_column(url).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)

    def score(batches):
        for batch in batches:
            found = [probability(sent.value, h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["id", "host", "path", "score"])

    scored = split.mapInArrow(score, f"id {split.schema['id'].dataType.simpleString()}, host string, path string, score double")
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.round("score", 6).alias("score"))
