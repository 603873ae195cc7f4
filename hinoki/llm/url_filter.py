"""URL filters: rules, and gradient-boosted trees on lexical features (operator 9)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .process import map_batches

#: Labelled URLs that the trees are fitted on at most: those with the smallest hash.
FIT_ROWS = 20_000
#: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "params", "query_length", "fragment", "hyphens", "suffix_rate", "first_segment_rate", "extension_rate")


# -- rules, in SQL functions ---------------------------------------------------
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2**31 - 1)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    fold = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(fold, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


# -- lexical features ------------------------------------------------------------
def _split(url: str) -> tuple[str, str, str, str]:
    """host, path, query, fragment."""
    rest = url.partition("://")[2]
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path, query, fragment


@dataclass
class Suffixes:
    """Share of blocked URLs by suffix, by first path segment and by file extension, smoothed."""

    tables: list[dict[str, float]] = field(default_factory=lambda: [{}, {}, {}])
    prior: float = 0.5

    @staticmethod
    def keys(url: str) -> tuple[str, str, str]:
        host, path, _, _ = _split(url)
        segments = path.split("/")
        first = segments[1] if len(segments) > 2 else ""
        return ".".join(host.split(".")[-2:]), first, segments[-1].rpartition(".")[2] if "." in segments[-1] else ""

    @classmethod
    def fit(cls, urls: Sequence[str], y: np.ndarray, strength: float = 20.0) -> Suffixes:
        prior = float(y.mean())
        tables = []
        for i in range(3):
            total, bad = Counter(), Counter()
            for u, t in zip(urls, y):
                key = cls.keys(u)[i]
                total[key] += 1
                bad[key] += t
            tables.append({k: (bad[k] + strength * prior) / (n + strength) for k, n in total.items()})
        return cls(tables, prior)

    def of(self, url: str) -> list[float]:
        return [t.get(k, self.prior) for t, k in zip(self.tables, self.keys(url))]


def features(url: str | None, suffixes: Suffixes) -> list[float]:
    url = url or ""
    host, path, query, fragment = _split(url)
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    digits = sum(c.isdigit() for c in url)
    return [n, len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, digits / n if n else 0.0, entropy, len([p for p in query.split("&") if p]), len(query), float(bool(fragment)), url.count("-"), *suffixes.of(url)]


# -- gradient boosting ---------------------------------------------------------
@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, stored level by level."""

    depth: int
    base: float
    split_on: np.ndarray  # trees x inner nodes
    split_at: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for on, at, leaf in zip(self.split_on, self.split_at, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, on[node]] > at[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Histogram boosting: best gain over quantile bins at each node, level by level."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1)
    width = bins + 1
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = math.log(p / (1 - p))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    on, at, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for j in range(d):
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for c in np.flatnonzero(top > best + 1e-9):
                    best[c], on[t, first + c], at[t, first + c] = top[c], j, cuts[j][k[c]]
            node = 2 * node + 1 + (x[np.arange(n), on[t, node]] > at[t, node])
        leaf_of = node - inner
        leaf[t] = rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + l2)
        score += leaf[t][leaf_of]
    return Trees(depth, base, on, at, leaf)


@dataclass
class UrlModel:
    suffixes: Suffixes
    trees: Trees | None
    constant: bool = False

    @classmethod
    def fit(cls, urls: Sequence[str], blocked: Sequence[bool]) -> UrlModel:
        """Without two classes the verdict is the one class seen, or allow."""
        y = np.asarray(blocked, float)
        if not len(y) or y.min() == y.max():
            return cls(Suffixes(), None, bool(len(y) and y[0]))
        # Rates come from one half and trees from the other; rates of a URL's own label would give it away.
        suffixes = Suffixes.fit(urls[::2], y[::2])
        rest = urls[1::2] or urls
        return cls(suffixes, fit_trees(np.array([features(u, suffixes) for u in rest]), y[1::2] if len(urls) > 1 else y))

    def blocked(self, urls: Sequence[str | None]) -> np.ndarray:
        if self.trees is None or not len(urls):
            return np.full(len(urls), self.constant)
        return self.trees.score(np.array([features(u, self.suffixes) for u in urls])) > 0


def fit_on(labelled: DataFrame, url_col: str, blocked_col: str, fit_rows: int = FIT_ROWS) -> UrlModel:
    """A model from at most ``fit_rows`` distinct labelled URLs: those whose hash is smallest.

    Hashes above a threshold that leaves about twice as many URLs go first, so each
    partition sends its part of these to the driver, however many partitions there are.
    """
    rows = labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{blocked_col}`").alias("blocked")).filter("url is not null and blocked is not null")
    rows = rows.select("url", "blocked", F.xxhash64("url").alias("h"))
    share = 2 * fit_rows / max(1, rows.agg(F.approx_count_distinct("url")).first()[0])
    below = rows.filter(F.col("h") < F.lit(int(share * 2**64) - 2**63)) if share < 1 else rows
    first = lambda df: df.distinct().orderBy("h", "url", "blocked").limit(fit_rows).collect()
    got = first(below)
    if share < 1 and len(got) < fit_rows:  # the count was far off
        got = first(rows)
    return UrlModel.fit([r["url"] for r in got], [r["blocked"] for r in got])


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    The longest fitting rule decides; other URLs are judged by the trees. Without a
    ``model`` these are fitted on the URLs that rules decide, labelled by the rules.
    Null URLs and URLs without ``://`` have an empty host and path, so no rule fits,
    and the trees judge them by what is left (a null URL counts as empty). Repeated
    rows and equal URLs get equal verdicts; URLs of any length are read whole. Other
    columns don't take part. An empty table gives an empty result.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    src = src.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = src.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), "url")
    if model is None:
        labelled = ruled.filter("rule is not null").select("url", (F.col("verdict") == "block").alias("blocked"))
        model = fit_on(labelled, "url", "blocked")
    fitted = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdict, urls = b.column(4).to_pylist(), b.column(5).to_pylist()
            todo = [i for i, v in enumerate(verdict) if v is None]
            for i, bad in zip(todo, fitted.blocked([urls[i] for i in todo])):
                verdict[i] = "block" if bad else "allow"
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return map_batches(ruled, run, ruled.drop("url").schema)
