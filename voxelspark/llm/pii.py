"""Personal data by weak supervision, in native columns.

Base kinds (email, ip, card, phone) are fixed patterns and always stay. Beyond them,
candidate spans (keyed secrets, disguised addresses, local phone numbers, identity
numbers, names after titles) are voted on by labelers: patterns of shape, gazetteers, and
the words around a span. Each may say yes, no or nothing. Expectation-maximisation over
the counts of vote patterns in the whole corpus estimates, for each kind of data, how
reliable each labeler is; its posteriors train a logistic span classifier, which decides
the candidates.

Votes are counted on the executors: what reaches the driver is one row per distinct
pattern of votes and features, a number that does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .text import col, free_name, let, whole

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "contact", "local_phone", "identity", "person")
#: The base patterns. Look-behinds and possessive loops find the same leftmost matches, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Candidate patterns, in the order in which a kind is told from its text.
CANDIDATES = {
    "secret": r"(?i:passwords?|passwd|passphrase|passwort|contraseña|pwd|tokens?|secrets?|api[_-]?keys?|access[_-]?keys?|auth[_-]?keys?)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.~-]{6,}+",
    "contact": r"[A-Za-z0-9._%+-]{2,64}+\x20?[\[({](?i:at)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?i:dot)[\])}])\x20?[A-Za-z0-9-]++)++",
    "identity": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "person": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
}
#: Words that speak for a kind of data when they stand before it. A secret's key is part of its pattern
#: and would be no second voice.
CUES = {
    "contact": "mail|contact|write|reach|kontakt|correo|courriel|address",
    "identity": "ssn|social security|iban|passport|account|konto|compte|cuenta|tax|id",
    "local_phone": "tel|phone|call|fax|mobile|cell|telefon|tél|móvil|text",
    "person": "dear|contact|by|from|with|signed|patient|name|von|de",
}
#: Given names.
GIVEN_NAMES = "Anna|Anne|Carlos|Charles|David|Elena|Emma|Frank|Hans|James|Jan|Jean|John|José|Juan|Karl|Laura|Linda|Luis|Maria|Marie|Mark|Martin|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sophie|Thomas|William"
#: Text that stands for data without being any.
PLACEHOLDERS = "(?i)^(?:changeme|example|password|none|null|true|false|test|todo|your.*|x+|0+|1234.*|abc.*|[*.]+|(?:000|666|9[0-9]{2})-.*)$"
UNLIKELY = "(?i)(?:version|isbn|issn|page|figure|chapter|order|serial|model|invoice|https?://)[^A-Za-z]*$"
LABELERS = ("shape", "variety", "cue", "names", "placeholder", "context", "unlikely")
CONTEXT = 40


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, text>> of the kind's matches that pass its test, in order."""
    passes = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"),
        "card": lambda m: let(F.regexp_replace(m, r"[\x20-]", ""), lambda d: F.length(d).between(16, 19) & luhn(d)),
        "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
    }[kind]
    return F.filter(matches(text, PATTERNS[kind], NEEDS[kind]), lambda s: passes(s["text"]))


def luhn(digits: Column) -> Column:
    """Whether 20 digits at most pass the Luhn test; zeros in front change nothing."""
    full = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for k in range(20):
        d = F.substring(full, k + 1, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if k % 2 == 0 else d)
    return F.coalesce(total % 10 == 0, F.lit(False))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, text>> of a pattern's leftmost matches, in code points.

    Matches are set between marks, the text is cut at the marks, and the pieces' lengths
    added up. The mark is a control character that no pattern matches; where a text holds
    it, another such character takes its place first, which moves nothing.
    """
    kind = "array<struct<start: int, end: int, text: string>>"
    none = F.array().cast(kind)
    clean = F.when(F.contains(text, F.lit("\x01")), F.translate(text, "\x01", "\x02")).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, pattern, "\x01$0\x01"), "\x01")

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x)
        span = F.struct(s["at"].alias("start"), end.alias("end"), x.alias("text"))
        return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"], F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))
    has = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    return F.when(has, F.aggregate(pieces, start, step, lambda s: s["out"]).cast(kind)).otherwise(none)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind, start, end, votes, size, digits>>: candidate spans that meet no base span."""
    pattern = "|".join(CANDIDATES[k] for k in CANDIDATES)
    found = matches(text, pattern, pattern)

    def judged(s: Column) -> Column:
        whole_match = s["text"]
        kind = F.lit(None).cast("string")
        for k in reversed(list(CANDIDATES)):
            kind = F.when(whole_match.rlike(f"^(?:{CANDIDATES[k]})$"), F.lit(k)).otherwise(kind)
        # A secret is what follows its key.
        value = F.when(whole_match.rlike("[=:]"), F.regexp_extract(whole_match, r"[=:]\x20?[\"']?([A-Za-z0-9+/_.~-]+)$", 1)).otherwise(whole_match)
        value = F.when(kind == "secret", value).otherwise(whole_match)
        start = s["end"] - F.length(value)
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        return let(F.struct(kind.alias("kind"), start.alias("start"), s["end"].alias("end"), value.alias("value"), before.alias("before")), voted)

    def voted(c: Column) -> Column:
        vote = lambda yes, no: F.when(yes, F.lit("1")).when(no, F.lit("0")).otherwise(F.lit("-"))
        kind, value, before = c["kind"], c["value"], c["before"]
        digits = F.length(value) - F.length(F.regexp_replace(value, "[0-9]", ""))
        letters = F.length(value) - F.length(F.regexp_replace(value, "[A-Za-z]", ""))
        distinct = F.size(F.array_distinct(F.split(value, "")))
        secret = kind == "secret"
        shape = vote(
            (secret & (digits > 0) & (letters > 0) & (F.length(value) >= 8)) | ((kind == "contact") & value.rlike("[A-Za-z]{2,}$")) | ((kind == "identity") & (digits >= 9)) | ((kind == "local_phone") & value.rlike(r"^\(?[2-9]")) | ((kind == "person") & value.rlike(r"\x20.+\x20")),
            (secret & ((digits == 0) | value.rlike(r"[/.]$"))) | ((kind == "local_phone") & value.rlike(r"^\(?[01]")),
        )
        variety = F.when(secret, vote(distinct >= 8, distinct < 5)).otherwise(F.lit("-"))
        cue = F.lit(False)
        for k, words in CUES.items():
            cue = cue | ((kind == k) & before.rlike(f"(?i)(?:{words})[^A-Za-z]*$"))
        names = F.when(kind == "person", vote(value.rlike(f"(?:{GIVEN_NAMES})"), F.lit(False))).otherwise(F.lit("-"))
        near = F.lit(False)
        for k, words in CUES.items():
            near = near | ((kind == k) & before.rlike(f"(?i)(?<![A-Za-z])(?:{words})"))
        votes = F.concat(shape, variety, vote(cue, F.lit(False)), names, vote(F.lit(False), value.rlike(PLACEHOLDERS)), vote(near, kind.isin("local_phone", "identity")), vote(F.lit(False), before.rlike(UNLIKELY)))
        size = F.when(F.length(value) < 10, 0).when(F.length(value) < 16, 1).when(F.length(value) < 30, 2).otherwise(3)
        share = F.floor(2 * digits / F.greatest(F.length(value), F.lit(1))).cast("int")
        return F.struct(kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), votes.alias("votes"), size.alias("size"), share.alias("digits"))

    return F.filter(F.transform(found, judged), lambda c: c["kind"].isNotNull() & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, extra): base spans as (start, end) and voted candidates. Null texts are empty."""
    rows = docs.select(col(id_col).alias("doc_id"), whole(col(text_col)).alias("text"))
    rows = rows.withColumn("base", F.struct(*[F.transform(base_spans(F.col("text"), k), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in BASE]))
    rows = rows.withColumn("extra", candidates(F.col("text"), F.concat(*[F.col("base")[k] for k in BASE])))
    return rows.select("doc_id", *[F.col("base")[k].alias(k) for k in BASE], "extra")


@dataclass
class Model:
    """Weights of the span classifier by feature name, and the labelers' estimated reliabilities."""

    weights: dict[str, float] = field(default_factory=dict)
    #: For each kind and labeler: P(votes yes | data, votes) and P(votes yes | no data, votes).
    reliability: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    #: For each kind: the share of its candidates that are data.
    prior: dict[str, float] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        score = F.lit(self.weights.get("bias", 0.0))
        for name, w in self.weights.items():
            what, _, value = name.partition("=")
            if what == "vote":
                kind, _, at = value.partition(".")
                j, v = int(at[:-1]), at[-1]
                score = score + F.when((c["kind"] == kind) & (F.substring(c["votes"], j + 1, 1) == v), F.lit(w)).otherwise(0.0)
            elif what in ("kind", "size", "digits"):
                score = score + F.when(c[what].cast("string") == value, F.lit(w)).otherwise(0.0)
        return score > 0


def expectation_maximisation(votes: Sequence[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Two-class Dawid-Skene with abstention: (P(yes | class) for each labeler, prior, posterior of each pattern)."""
    yes = np.array([[v == "1" for v in x] for x in votes], dtype=float)
    no = np.array([[v == "0" for v in x] for x in votes], dtype=float)
    # Row 0: P(yes | data), row 1: P(yes | none); every labeler starts better than chance.
    p, prior = np.stack([np.full(yes.shape[1], 0.85), np.full(yes.shape[1], 0.15)]), 0.5
    post = np.full(len(counts), 0.5)
    for _ in range(rounds):
        logs = [np.log(c) + yes @ np.log(q) + no @ np.log(1 - q) for c, q in ((prior, p[0]), (1 - prior, p[1]))]
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -30, 30)))
        for k, w in enumerate((post * counts, (1 - post) * counts)):
            # Counts of a prior belief of eight votes keep rare patterns from deciding.
            good = 0.85 if k == 0 else 0.15
            p[k] = np.clip((w @ yes + 8 * good) / (w @ (yes + no) + 8), 0.02, 0.98)
        prior = float(np.clip((post @ counts + 2) / (counts.sum() + 4), 0.02, 0.98))
    return p, prior, post


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by Newton's method."""
    w, weight = np.zeros(x.shape[1]), weight * (len(weight) * 50 / max(weight.sum(), 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates of spans(); without any, a model that accepts none."""
    c = found.select(F.explode("extra").alias("c")).select("c.kind", "c.votes", "c.size", "c.digits")
    rows = sorted(tuple(r) for r in c.groupBy("kind", "votes", "size", "digits").count().collect())
    if not rows:
        return Model(weights={"bias": -1.0})
    counts, post = np.array([r[4] for r in rows], dtype=float), np.zeros(len(rows))
    model = Model()
    for kind in sorted({r[0] for r in rows}):
        own = np.array([r[0] == kind for r in rows])
        p, model.prior[kind], post[own] = expectation_maximisation([r[1] for r in rows if r[0] == kind], counts[own])
        model.reliability |= {(kind, k): (float(p[0, j]), float(p[1, j])) for j, k in enumerate(LABELERS)}
    names = sorted({n for r in rows for n in _features(r)})
    x = np.array([[1.0, *[float(n in _features(r)) for n in names]] for r in rows])
    # Each kind weighs as much as another, so that a rare one has its say.
    share = np.array([counts[i] / sum(c for q, c in zip(rows, counts, strict=True) if q[0] == r[0]) for i, r in enumerate(rows)])
    model.weights = dict(zip(["bias", *names], logistic(x, post, share).tolist(), strict=True))
    return model


def _features(row) -> set[str]:
    kind, votes, size, digits = row[:4]
    return {f"kind={kind}", f"size={size}", f"digits={digits}", *(f"vote={kind}.{j}{v}" for j, v in enumerate(votes) if v != "-")}


def listed(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of (kind, spans) by kind and start, joined by commas."""
    # A second parameter of a lambda would be the index, so kinds are bound outside.
    def labelled(k: str):
        return lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.sort_array(s), labelled(k)) for k, s in kinds]), ",")


def report(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts and lists of base spans, and the list of all spans."""
    good = F.filter("extra", lambda c: model.accepts(c))
    rows = found.withColumn("good", good)
    base = [(k, F.col(k)) for k in BASE]
    of_kind = lambda k: F.filter("good", lambda c: c["kind"] == k)
    more = [(k, F.transform(of_kind(k), lambda c: F.struct(c["start"], c["end"]))) for k in EXTRA]
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], listed(base).alias("base"), listed([*base, *more]).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """report() of every row of docs, with the model fitted on all of docs' candidates.

    Null and empty texts have no spans; repeated rows are each reported; an empty table
    gives an empty table. Places count code points, ends are exclusive. A text of any length
    is searched whole, by one task. Other columns of docs are not read.
    """
    found = keep(spans(docs, id_col, text_col), "pii-spans")
    return report(found, fit(found))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; null texts stay null."""
    name = free_name(docs.columns, "pii_spans")
    text = whole(col(text_col))

    def of_base(base: Column) -> Column:
        good = F.filter(candidates(text, F.concat(*[base[k] for k in BASE])), model.accepts)
        marked = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))
        marks = [F.transform(base[k], marked(k)) for k in BASE]
        return F.sort_array(F.concat(*marks, F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))))

    base = F.struct(*[F.transform(base_spans(text, k), lambda s: F.struct(s["start"], s["end"])).alias(k) for k in BASE])
    rows = docs.withColumn(name, let(base, of_base))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        # Where kinds overlap, the span that starts first is replaced, and what is left of the next.
        low = F.greatest(s["at"], x["start"])
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, low - s["at"]), F.when(x["end"] > s["at"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
        return F.struct(piece.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(col(name), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(col(text_col).isNotNull(), done)).drop(name)
