"""URL filter: explicit rules first, gradient-boosted trees for the rest. DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains, if the
URL's path starts with its path, and the longest rule that fits decides. URLs
that a rule decides are the labelled URLs from which the trees learn; the trees
judge all others by lexical features: lengths, depth, share of digits, entropy
of the characters, number of parameters, and statistics of suffixes.

Training takes about ``SAMPLE`` labelled URLs (a documented bound, chosen by a
hash of the URL); Spark reduces them to counts of equal binned feature rows,
and boosting with logistic loss fits small trees to these counts on the driver.
The fitted trees are one column expression. With fewer than two labels, or
none, every other URL gets ``DEFAULT``, or the one label there is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK, DEFAULT = "allow", "block", "allow"
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, RIDGE = 20, 3, 0.3, 1.0
#: Upper edges of the bins of each feature.
BINS: dict[str, tuple[float, ...]] = {
    "length": (20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100, 130, 200),
    "host_length": (8, 12, 16, 18, 20, 22, 24, 26, 28, 32, 40, 60),
    "path_length": (0, 1, 4, 6, 8, 9, 10, 12, 16, 24, 40, 80),
    "labels": (1, 2, 3, 4, 5, 6),
    "depth": (0, 1, 2, 3, 4, 6, 8),
    "digits": (0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5),
    "entropy": (3.0, 3.2, 3.4, 3.6, 3.7, 3.8, 3.9, 4.0, 4.1, 4.2, 4.4, 4.6, 5.0),
    "parameters": (0, 1, 2, 3, 5, 8),
    "marks": (0, 1, 2, 3, 5, 8),
    "top_rate": (0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9),
    "file_rate": (0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9),
}
#: Suffixes whose rates are kept: the most frequent of the sample.
SUFFIXES = 100
SMOOTH = 10.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        """``allow example.org/es/``"""
        verdict, where = line.split()
        host, slash, path = where.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule.parse(x) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits; of equally long ones, the first. Else null."""
    found = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, what))).otherwise(found)
    return found


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    value = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(value), F.lit(1))
    digits = F.length(value) - F.length(F.translate(value, "0123456789", ""))
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size
    letters = F.array_distinct(F.array_remove(F.split(value, ""), ""))
    query = F.regexp_extract(value, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(value).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digits": digits / size,
        "entropy": F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "marks": (F.length(value) - F.length(F.translate(value, "-_~%@=+", ""))).cast("double"),
        "top": F.substring_index(host, ".", -1),
        "file": F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)),
    }


def _bin(name: str) -> Column:
    edges = F.array(*[F.lit(float(x)) for x in BINS[name]])
    return F.size(F.filter(edges, lambda e: e < F.col(name)))


@dataclass
class Tree:
    """A split at ``feature`` bin <= ``at``, or a leaf."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    below: list[Tree] = field(default_factory=list)

    def of(self, row: dict[str, int]) -> float:
        return self.below[row[self.feature] > self.at].of(row) if self.below else self.value

    def column(self) -> Column:
        if not self.below:
            return F.lit(self.value)
        limit = BINS[self.feature][self.at]
        return F.when(F.col(self.feature) <= float(limit), self.below[0].column()).otherwise(self.below[1].column())


def _grow(rows: list[tuple[dict[str, int], float, float]], depth: int) -> Tree:
    """rows: bins, gradient, curvature. The split with the largest gain; of equal ones the first."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(RATE * g / (h + RIDGE))
    if not depth:
        return leaf
    best = (1e-9, "", 0)
    for name, edges in BINS.items():
        sums = [[0.0, 0.0] for _ in range(len(edges) + 1)]
        for bins, gradient, curvature in rows:
            sums[bins[name]][0] += gradient
            sums[bins[name]][1] += curvature
        gl = hl = 0.0
        for at in range(len(edges)):
            gl, hl = gl + sums[at][0], hl + sums[at][1]
            if hl > 1e-12 and h - hl > 1e-12:
                gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                if gain > best[0]:
                    best = (gain, name, at)
    if not best[1]:
        return leaf
    _, name, at = best
    return Tree(0.0, name, at, [_grow([r for r in rows if (r[0][name] > at) is side], depth - 1) for side in (False, True)])


@dataclass
class Booster:
    """What is learned: rates of suffixes, the prior and the trees."""

    top: dict[str, float]
    file: dict[str, float]
    prior: float
    trees: list[Tree]

    def _rate(self, name: str) -> Column:
        found = F.lit(1 / (1 + math.exp(-self.prior)))
        for suffix, rate in sorted(getattr(self, name).items()):
            found = F.when(F.col(name) == suffix, F.lit(rate)).otherwise(found)
        return found

    def with_rates(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"{n}_rate": self._rate(n) for n in ("top", "file")})

    def score(self) -> Column:
        """Probability that the URL is to be blocked."""
        margin = sum((t.column() for t in self.trees), F.lit(self.prior))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _rates(rows: list, name: str, base: float) -> dict[str, float]:
    seen: dict[str, list[float]] = {}
    for r in rows:
        own = seen.setdefault(r[name], [0.0, 0.0])
        own[0] += r["n"]
        own[1] += r["n"] * r["label"]
    most = sorted(seen, key=lambda s: (-seen[s][0], s))[:SUFFIXES]
    return {s: (seen[s][1] + SMOOTH * base) / (seen[s][0] + SMOOTH) for s in most}


def fit(labelled: DataFrame) -> Booster | None:
    """labelled: the features of URLs that a rule decides, with their verdict. None without two labels."""
    count = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("__url"), F.lit(1_000_000)) < F.lit(min(1_000_000, SAMPLE * 1_000_000 // max(count, 1) + 1)))
    plain = [n for n in BINS if not n.endswith("_rate")]
    counted = chosen.select((F.col("__verdict") == BLOCK).cast("int").alias("label"), *[_bin(n).alias(n) for n in plain], "top", "file")
    rows = counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*counted.columns).collect()
    total, blocked = sum(r["n"] for r in rows), sum(r["n"] * r["label"] for r in rows)
    if not 0 < blocked < total:
        return None
    base = blocked / total
    model = Booster(_rates(rows, "top", base), _rates(rows, "file", base), math.log(base / (1 - base)), [])
    place = lambda name, rate: sum(e < rate for e in BINS[name])
    seen: dict[tuple, list[float]] = {}
    for r in rows:
        bins = {n: r[n] for n in plain} | {f"{n}_rate": place(f"{n}_rate", getattr(model, n).get(r[n], base)) for n in ("top", "file")}
        own = seen.setdefault(tuple(bins[n] for n in BINS), [0.0, 0.0])
        own[r["label"]] += r["n"]
    data = [(dict(zip(BINS, key, strict=True)), *counts) for key, counts in seen.items()]
    margins = [model.prior] * len(data)
    for _ in range(ROUNDS):
        graded = []
        for (bins, good, bad), margin in zip(data, margins, strict=True):
            p = 1 / (1 + math.exp(-margin))
            graded.append((bins, bad * (1 - p) - good * p, (good + bad) * p * (1 - p)))
        tree = _grow(graded, DEPTH)
        model.trees.append(tree)
        margins = [m + tree.of(bins) for m, (bins, _, _) in zip(margins, data, strict=True)]
    return model


def judge(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if none are named), host, path, rule (null if none fits), verdict, block_score (null if a rule fits).

    Null URLs, and URLs without ``://``: empty host and path, judged by the
    trees. Input columns of the added names are dropped.
    """
    added = ["host", "path", "rule", "verdict", "block_score"]
    own = [c for c in (keep if keep is not None else pages.columns) if c not in added]
    host, path = F.col("__host"), F.col("__path")
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(url).alias("__url"))
    rows = rows.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    rows = rows.withColumns({"__rule": rule_of(rules, host, path, "text"), "__verdict": rule_of(rules, host, path, "verdict")})
    rows = rows.withColumns(_features(F.col("__url"), host, path))
    model = fit(rows.where(F.col("__rule").isNotNull()))
    if model is None:
        only = rows.where(F.col("__rule").isNotNull()).select("__verdict").limit(1).collect()
        score = F.lit(float((only[0][0] if only else DEFAULT) == BLOCK))
    else:
        rows, score = model.with_rates(rows), model.score()
    rows = rows.withColumn("__score", F.when(F.col("__rule").isNull(), score))
    verdict = F.coalesce("__verdict", F.when(F.col("__score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__score").alias("block_score"))
