"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver from a small labelled URL table (a bounded number of rows) and its weights, of fixed
size, are broadcast. Rules are looked up by the host's suffixes in a table of bounded size.
"""

from __future__ import annotations

import itertools
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; a larger table is refused. At most so many labelled URLs train the classifier.
MAX_RULES, MAX_LABELLED = 100_000, 20_000
#: Hashed features, n-gram lengths, score from which a URL is blocked.
SLOTS, GRAMS, BLOCK_FROM = 1 << 14, (3, 4), 0.5

# The rules of the query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

# Parts of the labelled URL table (see labelled_urls).
UNWANTED = "casino jackpot poker betting slots escort xxx adult porn camgirls viagra pills cheapmeds payday-loan crypto-giveaway freeiphone winprize torrent-crack keygen warez replica-watches hotdeals-now click2win sexdate adult-video freebets sportbets casino-bonus cheap-meds pills-shop ads-server ad-track tracker-pixel spam-mail link-farm content-farm".split()
WANTED = "university library weather museum recipes gardening physics history news travel-guide astronomy biology council school health-advice orchestra cycling chess poetry archive engineering software-docs railway geography farm-school track-cycling free-library".split()
HOSTS = ["{}.com", "www.{}.net", "{}-online.org", "blog.{}.example.com", "m.{}.info", "my-{}.example.org"]
PATHS = ["/", "/en/{}/index.html", "/en/31204", "/2021/05/{}-and-more", "/page/{}?ref=a", "/de/20117.html"]

SYLLABLES = "ba co di fu ge hi jo ka lu me no pi ro sa te vu".split(), "mon ler sta nik rand vel".split()
PLAIN_HOSTS, TOPS = ["{}", "www.{}", "blog.{}", "m.{}", "en.{}"], "com net org info example.com example.net example.org".split()
LANGS, TAILS = "en de fr es".split(), ["", "/", ".html", "?p=2"]


def labelled_rows() -> list[tuple[str, int, set[str]]]:
    """(url, label, words in it): every word in every host form, with each path form in turn; and numbered pages of ordinary hosts, as crawls are
    full of them, whose names are all pairs of syllables."""
    out = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for j, host in enumerate(HOSTS):
                other = words[(i + 7 * j + 1) % len(words)]
                out.append((f"https://{host.format(word)}{PATHS[(i + j) % len(PATHS)].format(other)}", label, {word, other}))
    for i, name in enumerate(map("".join, itertools.product(*SYLLABLES))):
        pick = lambda of, every=1: of[i // every % len(of)]
        out.append((f"{pick(['http', 'https'])}://{pick(PLAIN_HOSTS).format(name)}.{pick(TOPS)}/{pick(LANGS)}/{17 * i * i + 3}{pick(TAILS, 4)}", 0, {name}))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table."""
    return [(url, label) for url, label, _ in labelled_rows()]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): A-Z of the host lower-cased; both empty for null or without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


LOWER = {c: c + 32 for c in range(65, 91)}


def features(host: str, path: str) -> np.ndarray:
    """Slots of the n-grams of host and of path, each part with its own mark at the ends."""
    out = []
    for part in (f"^{host}$", f"<{path}>"):
        raw = part.encode()
        for n in GRAMS:
            out += [crc32(raw[i : i + n], n) % SLOTS for i in range(len(raw) - n + 1)]
    return np.unique(np.array(out, np.int64)) if out else np.zeros(0, np.int64)


class UrlClassifier:
    """Logistic regression, fitted by full-batch gradient descent with L2; deterministic."""

    def __init__(self, labelled: list[tuple[str, int]], epochs: int = 300, rate: float = 2.0, ridge: float = 1e-3):
        if len(labelled) > MAX_LABELLED:
            raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
        rows = [features(*split_url(u)) for u, _ in labelled]
        y = np.array([label for _, label in labelled], float)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        slot = np.concatenate([*rows, np.zeros(0, np.int64)])
        norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))
        self.weights, self.bias = np.zeros(SLOTS), 0.0
        for _ in range(epochs if len(rows) else 0):
            p = 1 / (1 + np.exp(-(np.bincount(row, self.weights[slot], len(rows)) * norm + self.bias)))
            g = (p - y) / len(rows)
            self.weights -= rate * (np.bincount(slot, (g * norm)[row], SLOTS) * 10 + ridge * self.weights)
            self.bias -= rate * g.sum()

    def score(self, host: str, path: str) -> float:
        f = features(host, path)
        return float(1 / (1 + np.exp(-(self.weights[f].sum() / np.sqrt(max(len(f), 1)) + self.bias))))


class RuleTable:
    """Rules `host/path-prefix`: each fits its host and all subdomains; the longest that fits wins."""

    def __init__(self, rules: list[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(LOWER), []).append((len(rule), rule, slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (-1, None, None)
        while True:
            for size, rule, start, verdict in self.by_host.get(host, ()):
                if size > best[0] and path.startswith(start):
                    best = (size, rule, verdict)
            if "." not in host:
                return best[1], best[2]
            host = host.partition(".")[2]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]], url: str = "url") -> DataFrame:
    """All columns of `pages` and host, path, rule, score (of the classifier, null where a rule decides), verdict (allow or block).

    Null urls and those without `://` have empty host and path and are judged by the classifier on those. Of rules that tie in length the first listed wins. Every url is
    read whole, however long; repeated rows are judged alike; an empty table gives an empty result; columns named as the new ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    table, model = RuleTable(rules), UrlClassifier(labelled)
    # plain values, so that workers need not have this module
    sent = pages.sparkSession.sparkContext.broadcast((table.by_host, model.weights, model.bias))
    at, n = pages.columns.index(url), len(pages.columns)
    names = [*pages.columns, "host", "path", "rule", "score", "verdict"]
    schema = pages.select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(names[n:], ("string", "string", "string", "double", "string")))).schema

    def run(batches):
        table, model = RuleTable([]), UrlClassifier([])
        table.by_host, model.weights, model.bias = sent.value
        for b in batches:
            out = []
            for u in b.column(at).to_pylist():
                host, path = split_url(u)
                rule, verdict = table.find(host, path)
                score = None if rule else model.score(host, path)
                out.append((host, path, rule, score, verdict or ("block" if score >= BLOCK_FROM else "allow")))
            columns = list(zip(*out)) if out else [()] * 5
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    return pages.mapInArrow(run, schema)
