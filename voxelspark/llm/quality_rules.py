"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the
labelled rows by information gain, pruned on the other third, and kept while it is
precise there; the rows it covers leave, and the next rule is learned. The list becomes
an ordered CASE WHEN column. Statistics of all documents are native columns; only a
bounded sample of labelled documents goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, SYMBOLS, col, free_name, let, whole

#: Bound of the labelled sample, in documents (those of smallest id hash).
SAMPLE_DOCS = 6000
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 12, 4, 0.97, 8
#: Base rules.
MIN_WORDS, MOST_REPEATED = 50, 50


def words(text: Column) -> Column:
    """Array of the text's words, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more.

    Windows are hashed to 64 bits. For each text the hashes are sorted with their
    position packed into the low bits, neighbours are compared on the full hash, and the
    repeated positions' windows are measured as a union of intervals: n log n, no explode.
    """
    hashes = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: F.xxhash64(F.get(a, i - 1), F.get(a, i), F.get(a, i + 1)))

    def positions(h: Column) -> Column:
        mask = (F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(h) + F.lit(1.0))).cast("int")) - F.lit(1)).cast("long")

        def of(pair: Column) -> Column:
            low = pair["mask"]
            packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

            def repeats(s: Column) -> Column:
                at = lambda i: F.get(h, F.get(s, i).bitwiseAND(low).cast("int"))
                near = lambda x, i, j: F.coalesce(F.get(s, j).bitwiseXOR(x).bitwiseAND(F.bitwise_not(low)) == 0, F.lit(False)) & (at(i) == at(j))
                again = F.filter(s, lambda x, i: near(x, i, i - 1) | near(x, i, i + 1))
                return F.sort_array(F.transform(again, lambda x: x.bitwiseAND(low).cast("int")))

            return let(packed, repeats)

        return let(F.struct(mask.alias("mask")), of)

    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["at"]).cast("long")).alias("n"), x.alias("at")), lambda s: s["n"])

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered))

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes(w), of_hashes))


#: Names of the base statistics.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the rules are learned on.
FEATURES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "bar_ratio", "line_words", "upper_ratio", "digit_ratio", "distinct_ratio", "words")


def statistics(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the base statistics and features as columns of free names, and those names.

    One struct column holds all that is read from the text, with the word array bound
    once inside it, so no rewrite of the plan can move the split into an inner loop.
    """
    names = {k: free_name(docs.columns, k) for k in ("q_text", "q_all", *BASE, *(f"f_{x}" for x in FEATURES))}
    text = col(names["q_text"])
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
        )

    counts = F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        gone("[|]").alias("bars"),
        gone("[A-Z]").alias("upper"),
        gone("[0-9]").alias("digits"),
    )
    t = docs.withColumn(names["q_text"], whole(col(text_col))).withColumn(names["q_all"], counts)
    q = col(names["q_all"])
    n, chars, n_lines = F.greatest(q["w"]["n_words"], F.lit(1)), F.greatest(q["w"]["word_chars"], F.lit(1)), F.greatest(q["l"]["n"], F.lit(1))
    dup = q["l"]["n"] - q["l"]["d"]
    values = {
        "n_words": q["w"]["n_words"],
        "word_chars": q["w"]["word_chars"],
        "n_symbols": q["n_symbols"],
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": q["w"]["n_repeat_words"],
        "f_symbol_ratio": q["n_symbols"] / chars,
        "f_repeat_ratio": q["w"]["n_repeat_words"] / n,
        "f_dup_line_ratio": dup / n_lines,
        "f_mean_word": q["w"]["word_chars"] / n,
        "f_bar_ratio": q["bars"] / n,
        "f_upper_ratio": q["upper"] / chars,
        "f_digit_ratio": q["digits"] / chars,
        "f_distinct_ratio": q["w"]["n_distinct"] / n,
        "f_line_words": q["w"]["n_words"] / n_lines,
        "f_words": q["w"]["n_words"].cast("double"),
    }
    return t.withColumns({names[k]: v for k, v in values.items()}).drop(names["q_text"], names["q_all"]), names


@dataclass
class DecisionList:
    """Rules in order; the first that a document meets rejects it. A condition is (feature, '<=' or '>', threshold)."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self, values: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for name, way, at in rule:
                met = met & (values[name] <= F.lit(at) if way == "<=" else values[name] > F.lit(at))
            out = F.when(met, F.lit(True)) if out is None else out.when(met, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    def rejects_row(self, row: dict[str, float]) -> bool:
        """The same in plain Python."""
        return any(all(row[n] <= at if way == "<=" else row[n] > at for n, way, at in rule) for rule in self.rules)


def _meets(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, way, at in rule:
        out &= x[:, j] <= at if way == "<=" else x[:, j] > at
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list:
    """Add the threshold of highest gain until the rule covers no good row."""
    rule, rows = [], np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (~bad[rows]).any():
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        best = (1e-9, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[rows, j], kind="stable")
            v, b = x[rows, j][order], bad[rows][order]
            ends = np.flatnonzero(np.r_[v[1:] != v[:-1], False])
            if not len(ends):
                continue
            low_p, low_n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
            for way, pp, nn in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp >= MIN_COVER, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, way, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows &= _meets(x, [best[1]])
    return rule


def _prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    """The shortest of the rule's beginnings with the best (p - n) / (p + n)."""
    def worth(r):
        m = _meets(x, r)
        p, n = (m & bad).sum(), (m & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=rule)


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> DecisionList:
    """Sequential covering of the bad rows; row order decides which third prunes."""
    third = np.arange(len(x)) % 3 == 2
    left, out = np.ones(len(x), dtype=bool), []
    while len(out) < MAX_RULES and (left & bad & ~third).sum() >= MIN_COVER:
        rule = _grow(x[left & ~third], bad[left & ~third])
        if not rule:
            break
        rule = _prune(rule, x[left & third], bad[left & third])
        m = _meets(x, rule) & left
        if (m & bad).sum() < MIN_COVER or (m & bad).sum() / m.sum() < MIN_PRECISION:
            break
        out.append([(names[j], way, at) for j, way, at in rule])
        left &= ~m
    return DecisionList(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DecisionList:
    """Learn from labels (doc_id, quality), 0 being bad, on at most sample_docs documents.

    A document labelled both ways counts as good; null ids and labels are left out. Of rows
    that share an id the one of least statistics teaches, so one row a label reaches the
    driver at most. Documents that the base rules fail teach nothing. Without labels the
    list is empty. The same rows give the same list.
    """
    marks = labels.select(col("doc_id").alias("of"), col("quality").cast("int").alias("good")).dropna().groupBy("of").agg(F.max("good").alias("good"))
    some = F.broadcast(marks.orderBy(F.xxhash64("of"), "of").limit(sample_docs))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).join(some, F.col("doc_id") == F.col("of"))
    rows, at = statistics(rows, "text")
    base = base_failed({k: col(at[k]) for k in BASE}).alias("failed")
    row = F.struct("good", *[col(at[f"f_{k}"]).alias(k) for k in FEATURES], base)
    found = [r["row"] for r in rows.groupBy(F.col("doc_id").cast("string").alias("of")).agg(F.min(row).alias("row")).orderBy(F.md5("of"), "of").collect()]
    found = [r for r in found if not r["failed"]]
    if not found:
        return DecisionList()
    x = np.array([[r[k] for k in FEATURES] for r in found], dtype=float)
    return learn(x, np.array([r["good"] == 0 for r in found]), list(FEATURES))


def base_failed(s: dict[str, Column]) -> Column:
    return (s["n_words"] < MIN_WORDS) | (F.lit(100) * s["n_repeat_words"] > F.lit(MOST_REPEATED) * s["n_words"])


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the base statistics, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged
    alike; an empty table gives an empty table. Columns of ours replace those of the same name.
    """
    ours = (*BASE, "base_failed", "kept")
    base = docs.select(*[col(c) for c in docs.columns if c.lower() not in ours])
    t, at = statistics(base, text_col)
    failed = base_failed({k: col(at[k]) for k in BASE})
    rejected = rules.rejects({k: col(at[f"f_{k}"]) for k in FEATURES})
    return t.select(*[col(c) for c in base.columns], *[col(at[k]).alias(k) for k in BASE], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, in docs' columns.

    The row number beside the verdict keeps the filter above the projection: pushed below
    it, the filter would compute every statistic a second time.
    """
    names = [free_name(docs.columns, x) for x in ("q_kept", "q_row", "q_in_text", "q_in_id")]
    rows = docs.withColumns({names[2]: col(text_col), names[3]: col(id_col)})
    t, at = statistics(rows, names[2])
    good = ~base_failed({k: col(at[k]) for k in BASE}) & ~rules.rejects({k: col(at[f"f_{k}"]) for k in FEATURES})
    t = t.withColumns({names[0]: good, names[1]: F.monotonically_increasing_id()})
    return t.filter(col(names[0]) & (col(names[1]) >= 0)).select(*[col(c) for c in docs.columns])
