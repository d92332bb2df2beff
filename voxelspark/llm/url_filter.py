"""URL filters: allow and block rules, then gradient-boosted trees on lexical features.

Trees are fitted on the driver from a bounded sample of labelled URLs and become nested
CASE WHEN columns, so scoring any number of URLs is one native projection.

Where a caller has no labels, URLs are labelled by the topic words in their host names
(TOPIC_WORDS), and hosts made by a rule from those words and from PLAIN_WORDS join them
(seeds), alike in all but the words: with hyphens and without, with digits and without. So
no joiner marks a host, and what parts the two are the statistics of four-letter pieces,
which are learned from the labels as the suffixes' are. Each tree sees a part of the features.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, free_name

#: Parts of host names that mark a labelled URL as unwanted.
TOPIC_WORDS = ("ads", "adult", "bet", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: Parts of made host names of the other kind.
PLAIN_WORDS = ("blog", "bridge", "city", "clinic", "garden", "history", "jean", "library", "market", "museum", "music", "news", "paul", "river", "school", "science", "weather")
#: Rules (host and path prefix, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LAMBDA, LEAF = 24, 3, 0.3, 32, 1.0, 5.0
#: Share of the features that a tree sees.
PART = 0.6
#: Letters of a piece of a host, the most pieces whose statistics are kept, how often one must be seen, and folds.
PIECE, PIECES, PIECE_ROWS, FOLDS = 4, 300, 3, 4
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-."


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): host with A-Z lower-cased; null or no '://' gives empty strings."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(after, "(?s)^[^?#]*(.*)$", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    Among equally long rules the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        longer = F.lit(True) if rule is None else F.coalesce(F.length(rule) < len(text), F.lit(True))
        rule, verdict = F.when(fits & longer, F.lit(text)).otherwise(rule), F.when(fits & longer, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, rest: Column, suffix_rate: Column) -> dict[str, Column]:
    """Lexical features as doubles; entropy is of the host's characters, in bits."""
    whole = F.concat(host, path, rest)
    n, size = F.length(host), F.length(whole)
    entropy = F.lit(0.0)
    for c in ALPHABET:
        p = (n - F.length(F.replace(host, F.lit(c), F.lit("")))) / F.greatest(n, F.lit(1))
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    digits = size - F.length(F.regexp_replace(whole, "[0-9]", ""))
    out = {
        "length": size,
        "host_length": n,
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "host_parts": count(host, ".") + 1,
        "hyphens": count(host, "-"),
        "host_digits": n - F.length(F.regexp_replace(host, "[0-9]", "")),
        "digit_ratio": digits / F.greatest(size, F.lit(1)),
        "entropy": entropy,
        "params": count(rest, "="),
        "rest_length": F.length(rest),
        "suffix_rate": suffix_rate,
    }
    return {k: v.cast("double") for k, v in out.items()}


def seeds() -> list[tuple[str, int]]:
    """Labelled URLs by a rule: each word alone, joined with another or a digit run, under several suffixes."""
    out = []
    for label, words in ((1, TOPIC_WORDS), (0, PLAIN_WORDS)):
        for k, w in enumerate(words):
            for j, form in enumerate(("{w}", "my-{w}", "best{w}", "{w}-online", "{w}777", "{w}-24", "www.{w}", "the{w}{v}")):
                host = form.format(w=w, v=words[(k + 5) % len(words)])
                out.append((f"https://{host}.{('org', 'net', 'info', 'fr', 'com')[(k + j) % 5]}/{'a/' * (k % 3)}{17 * k + j}", label))
    return out


def pieces(host: str) -> list[str]:
    return [host[i : i + PIECE] for i in range(len(host) - PIECE + 1)]


def piece_rates(hosts: list[str], y: np.ndarray) -> dict[str, float]:
    """How far the log-odds of an unwanted URL move with each piece of its host, smoothed, for the pieces that tell most."""
    held: dict[str, list[float]] = {}
    for h, label in zip(hosts, y.tolist(), strict=True):
        for g in set(pieces(h)):
            n = held.setdefault(g, [0, 0])
            n[0] += 1
            n[1] += label
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    odds = lambda p: float(np.log(p / (1 - p)))
    moved = {g: (odds((k + 2 * prior) / (n + 2)) - odds(prior), n) for g, (n, k) in held.items() if n >= PIECE_ROWS}
    best = sorted(((abs(m) * np.sqrt(n), g, m) for g, (m, n) in moved.items() if abs(m) > 0.5), reverse=True)[:PIECES]
    return {g: round(m, 6) for _, g, m in best}


def piece_values(host: str, rates: dict[str, float]) -> tuple[float, float, float]:
    """(highest, lowest, sum) of the rates of a host's pieces."""
    found = [rates.get(g, 0.0) for g in pieces(host)]
    return max(found, default=0.0), min(found, default=0.0), float(sum(found))


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


#: Names of the features that piece_values() gives.
PIECE_NAMES = ("piece_high", "piece_low", "piece_sum")


@dataclass
class Trees:
    """Boosted trees; each is a nested tuple (feature, threshold, below or equal, above) or a leaf value."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    #: Suffix, and share of unwanted URLs among the labelled ones with it, smoothed.
    suffixes: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    #: Piece of a host, and how far it moves the log-odds.
    pieces: dict[str, float] = field(default_factory=dict)

    def piece_columns(self, host: Column) -> dict[str, Column]:
        """piece_values() as columns."""
        if not self.pieces:
            return {k: F.lit(0.0) for k in PIECE_NAMES}
        table = F.create_map(*[F.lit(x) for kv in sorted(self.pieces.items()) for x in kv])
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(host) - PIECE + 1, F.lit(1))), lambda i: i <= F.length(host) - PIECE + 1)
        found = F.transform(at, lambda i: F.coalesce(F.try_element_at(table, host.substr(i, F.lit(PIECE))), F.lit(0.0)))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return dict(zip(PIECE_NAMES, (zero(F.array_max(found)), zero(F.array_min(found)), F.aggregate(found, F.lit(0.0), lambda a, x: a + x)), strict=True))

    def score(self, values: dict[str, Column]) -> Column:
        """Log-odds of an unwanted URL."""
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + _column(t, values)
        return out

    def score_row(self, row: dict[str, float]) -> float:
        """The same in plain Python."""
        out = self.bias
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            out += t
        return out

    def suffix_rate(self, host: Column) -> Column:
        if not self.suffixes:
            return F.lit(self.prior)
        table = F.create_map(*[F.lit(x) for kv in sorted(self.suffixes.items()) for x in kv])
        return F.coalesce(F.try_element_at(table, suffix(host)), F.lit(self.prior))


def _column(t, values: dict[str, Column]) -> Column:
    if not isinstance(t, tuple):
        return F.lit(float(t))
    return F.when(values[t[0]] <= F.lit(float(t[1])), _column(t[2], values)).otherwise(_column(t[3], values))


def _boost(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, list]:
    """Second-order boosting of depth-wise trees on binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    margin, trees, rng = np.full(len(y), bias), [], np.random.default_rng(3)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAF:
            for j in seen:
                c = cuts[j]
                if not len(c):
                    continue
                n = len(c) + 1
                k = codes[rows, j]
                gl, hl, nl = (np.bincount(k, w, n).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + LAMBDA) + (total_g - gl) ** 2 / (total_h - hl + LAMBDA) - total_g**2 / (total_h + LAMBDA)
                gain = np.where((nl >= LEAF) & (len(rows) - nl >= LEAF), gain, 0)
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            value = float(-RATE * total_g / (total_h + LAMBDA))
            margin[rows] += value
            return value
        j, b = best[1]
        left = codes[rows, j] <= b
        return (names[j], float(cuts[j][b]), grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    for _ in range(TREES):
        seen = sorted(rng.permutation(len(cuts))[: max(1, round(PART * len(cuts)))].tolist())
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return bias, trees


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, more: list[tuple[str, int]] | None = None) -> Trees:
    """Fit on at most sample_rows labelled URLs, those of smallest hash, and on the (url, label) rows of more.

    Rows with a null URL or label are left out, rows that repeat one count once. Only rows
    whose hash falls under a bound, set from an estimate of how many there are, are sorted,
    so no more than the sample reaches the driver, however many parts the table has.
    Without rows, or with one class only, the trees are empty and the score is the prior
    log-odds (0 without rows).
    """
    rows = labelled.select(col(url_col).alias("url"), col(label_col).cast("int").alias("label")).dropna()
    total = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    if total > sample_rows:
        bound = int(-(2**63) + min(1.0, 1.2 * sample_rows / total) * (2**64 - 1))
        rows = rows.filter(F.xxhash64("url") <= F.lit(bound))
    rows = rows.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(sample_rows)
    if more:
        rows = rows.unionByName(labelled.sparkSession.createDataFrame(more, "url string, label int"))
    host, path, rest = parts(F.col("url"))
    found = rows.select(host.alias("h"), suffix(host).alias("s"), "label", *[v.alias(k) for k, v in features(host, path, rest, F.lit(0.0)).items()]).collect()
    if not found:
        return Trees()
    found.sort(key=tuple)
    y = np.array([r["label"] for r in found], dtype=float)
    prior = float(y.mean())
    held: dict[str, list[float]] = {}
    for r in found:
        held.setdefault(r["s"], []).append(float(r["label"]))
    rates = {s: (sum(v) + 10 * prior) / (len(v) + 10) for s, v in held.items() if len(v) >= 5}
    if y.min() == y.max():
        return Trees(bias=20.0 if prior else -20.0, suffixes=rates, prior=prior)
    names = [*list(found[0].asDict())[3:], *PIECE_NAMES]
    x = np.array([[*(r[k] for k in names[: -len(PIECE_NAMES)]), 0.0, 0.0, 0.0] for r in found], dtype=float)
    x[:, names.index("suffix_rate")] = [rates.get(r["s"], prior) for r in found]
    # Pieces of a host are rated by the hosts of the other folds, so a host doesn't vouch for itself.
    hosts = [r["h"] for r in found]
    fold = np.array([int(hashlib.md5(h.encode()).hexdigest()[:8], 16) % FOLDS for h in hosts])
    for k in range(FOLDS):
        others = fold != k
        rated = piece_rates([h for h, o in zip(hosts, others, strict=True) if o], y[others]) if others.any() else {}
        for i in np.flatnonzero(~others):
            x[i, -len(PIECE_NAMES) :] = piece_values(hosts[i], rated)
    bias, trees = _boost(x, y, names)
    return Trees(bias, trees, rates, prior, piece_rates(hosts, y))


def topic_labels(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label): 1 where a part of the host name, between dots and hyphens, is a topic word."""
    host, _, _ = parts(col(url_col))
    hit = F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in TOPIC_WORDS]))
    return pages.select(col(url_col).alias("url"), hit.cast("int").alias("label"))


def judge(pages: DataFrame, model: Trees, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict.

    A rule's verdict stands before the trees', which block a URL only if the pieces of its host
    that they know speak against it on the whole: a host of unknown pieces is allowed. A null URL, or one without '://', has an
    empty host and path and no rule; the trees judge it by its features like any other, and
    a URL of any length too.
    Repeated rows are judged alike. Columns of ours replace columns of the same name.
    """
    ours = ["host", "path", "rule", "verdict", "score"]
    base = pages.select(*[col(c) for c in pages.columns if c.lower() not in ours])
    host, path, rest = parts(col(url_col))
    t = base.withColumns({"host": host, "path": path, (r := free_name([*base.columns, *ours], "rest")): rest})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    values = features(F.col("host"), F.col("path"), col(r), model.suffix_rate(F.col("host"))) | model.piece_columns(F.col("host"))
    names = {k: free_name(t.columns, f"f_{k}") for k in values}
    t = t.withColumns({names[k]: v for k, v in values.items()})
    t = t.withColumn("score", model.score({k: col(n) for k, n in names.items()}))
    # The trees are fitted with more unwanted URLs than pages have, so form alone doesn't block: pieces must speak against the host.
    against = F.coalesce(col(names["piece_sum"]) > 0, F.lit(False))
    verdict = F.coalesce(says, F.when((F.col("score") > 0) & against, F.lit("block")).otherwise(F.lit("allow")))
    return t.select(*[col(c) for c in base.columns], "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
