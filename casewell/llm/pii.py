"""Personal data: fixed patterns, and further spans chosen by boosted trees.

Base spans follow fixed patterns with checks. High-recall generators then propose overlapping
candidates (assignments, long tokens, number-like runs); gradient-boosted trees score their
format and context, and a threshold calibrated on held-out examples selects. The trees are fit
on the driver to a table of examples made by rule, bounded by EXAMPLES, and become one CASE
expression; texts only meet DataFrame expressions.

Patterns match what the plain forms match, but cannot run away on long texts: quantifiers are
possessive, and a match begins at the end of the last one or where the text before it could not
have begun it."""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_of

KINDS = ("email", "ip", "card", "phone", "secret", "number")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The zeros that lead are taken first, so that a part may have no digit left.
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.|$)){4}$"
#: Generators of further candidates, with the kind they propose.
GENERATORS = {
    "assigned": ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]{2,}+\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{8,}+"),
    "token": ("secret", r"(?:\G|(?<![A-Za-z0-9+/_]))[A-Za-z0-9+/_]{16,}+"),
    "digits": ("number", r"(?:\G|(?<![0-9+]))[0-9](?:[\x20.()-]{0,2}+[0-9]){8,}+"),
}
#: Examples of each class, rounds, depth and step of the trees, characters of context.
EXAMPLES, ROUNDS, DEPTH, RATE, CONTEXT = 240, 24, 3, 0.4, 24
FEATURES = ("generator", "length", "digit_share", "upper_share", "hexadecimal", "separators",
            "changes", "keyword", "contact")
#: Fixed words of contexts.
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|credential"
CONTACT_WORDS = "card|phone|tel|call|mobile|iban|account|ssn|passport|tax"
TRAIN_SCHEMA = "array<struct<generator:int,before:string,body:string,label:int>>"


def running(lengths: Column) -> Column:
    """Running sums of an array of integers, by blocks of 128 so that long arrays stay cheap."""
    def total(a: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, start, n), F.lit(0), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 128).cast("int")),
                             lambda b: total(a, F.lit(1), b * 128))
        return let(blocks, lambda c: F.transform(a, lambda _, i: F.element_at(
            c, F.floor(i / 128).cast("int") + 1) + total(
                a, (F.floor(i / 128) * 128 + 1).cast("int"), i % 128 + 1)))
    return let(lengths, sums)


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order: array of (start, end, body), in code points. Text between
    matches and matches alternate, so positions are sums of their lengths."""
    empty = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def place(body: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(body))
        steps = F.zip_with(gaps, body, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(running(steps), body, lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("body")))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda body: F.when(F.size(body) == 0, empty).otherwise(place(body)))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def features(generator: Column, before: Column, body: Column) -> Column:
    """Format and context of a candidate."""
    n = F.greatest(F.length(body), F.lit(1))
    digits = F.length(_digits(body))
    return F.struct(
        generator.cast("double").alias("generator"), n.cast("double").alias("length"),
        (digits / n).alias("digit_share"),
        (F.length(F.regexp_replace(body, "[^A-Z]", "")) / n).alias("upper_share"),
        F.when(body.rlike("^(?:[A-Za-z_][A-Za-z0-9_-]+ ?[=:] ?[\"']?)?[0-9a-fA-F]{8,}$"), 1.0).otherwise(0.0)
        .alias("hexadecimal"),
        (F.length(F.regexp_replace(body, r"[^\x20.()_/-]", "")) / n).alias("separators"),
        (F.size(F.regexp_extract_all(body, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0)))
         / n).alias("changes"),
        F.when(F.lower(F.concat(before, body)).rlike(SECRET_WORDS), 1.0).otherwise(0.0).alias("keyword"),
        F.when(F.lower(before).rlike(rf"\b(?:{CONTACT_WORDS})\b"), 1.0).otherwise(0.0).alias("contact"))


def examples() -> list[dict]:
    """Labelled candidates made by rule: secrets and labelled numbers against words, paths,
    versions, dates, counts and measures."""
    rng, out = random.Random(11), []

    def some(chars: str, low: int, high: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, hexa = lower + upper + digit, digit + "abcdef"

    def add(label: int, generator: int, before: str, body: str) -> None:
        out.append({"generator": generator, "before": before, "body": body, "label": label})

    def prose() -> str:
        return " ".join(some(lower, 2, 9) for _ in range(3)) + " "

    for _ in range(EXAMPLES // 6):
        name = rng.choice(["password", "passwd", "token", "secret", "api_key", "pwd", "auth"])
        sign = rng.choice(["=", ": ", " = ", ":"])
        quote = rng.choice(["", '"', "'"])
        add(1, 0, prose(), name + sign + quote + some(rng.choice([hexa, mixed]), 10, 48))
        add(1, 1, prose(), rng.choice(["AKIA", "ASIA"]) + some(upper + digit, 16, 16))
        add(1, 1, prose() + name + sign + quote, some(rng.choice([hexa, mixed]), 18, 48))
        add(1, 1, prose(), some(hexa, 32, 64))
        add(1, 1, prose(), some(mixed, 24, 48))
        add(1, 2, prose() + rng.choice(["card", "phone", "account", "call", "tel"]) + " ",
            some(digit, 9, 16))
        add(0, 0, prose(), some(lower, 3, 9) + ": " + some(lower, 8, 14))
        add(0, 0, prose(), some(lower, 3, 9) + "=" + some(lower, 8, 20))
        add(0, 1, prose(), some(lower, 16, 60))
        add(0, 1, prose(), some(upper, 16, 40))
        add(0, 1, prose(), "/".join(some(lower, 3, 9) for _ in range(4)))
        add(0, 2, prose(), rng.choice([some(digit, 9, 16), "2024-01-30 12.00",
                                       f"{rng.randint(1000, 2000)} - {rng.randint(2001, 2100)} 7"]))
    return out


class Trees:
    """Gradient boosting with logistic loss on a small table."""

    def __init__(self, rows: list[list[float]], labels: list[int], rounds: int, depth: int,
                 rate: float):
        share = min(max(sum(labels) / max(1, len(labels)), 0.01), 0.99)
        self.base, self.trees = math.log(share / (1 - share)), []
        score = [self.base] * len(rows)
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [y - q for y, q in zip(labels, p, strict=True)]
            hess = [max(q * (1 - q), 1e-6) for q in p]
            tree = self._grow(rows, grad, hess, list(range(len(rows))), depth, rate)
            self.trees.append(tree)
            score = [s + self.value(tree, r) for s, r in zip(score, rows, strict=True)]

    def _grow(self, rows, grad, hess, idx, depth, rate):
        def gain(ids):
            return sum(grad[i] for i in ids) ** 2 / (sum(hess[i] for i in ids) + 1)

        leaf = rate * sum(grad[i] for i in idx) / (sum(hess[i] for i in idx) + 1)
        best = (1e-4, None)
        for f in range(len(FEATURES)) if depth else ():
            values = sorted({rows[i][f] for i in idx})
            cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
            for cut in cuts[::max(1, len(cuts) // 16)]:
                low = [i for i in idx if rows[i][f] <= cut]
                high = [i for i in idx if rows[i][f] > cut]
                if min(len(low), len(high)) >= 4:
                    better = gain(low) + gain(high) - gain(idx)
                    if better > best[0]:
                        best = (better, (f, cut, low, high))
        if best[1] is None:
            return leaf
        f, cut, low, high = best[1]
        return (f, cut, self._grow(rows, grad, hess, low, depth - 1, rate),
                self._grow(rows, grad, hess, high, depth - 1, rate))

    @staticmethod
    def value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.base + sum(self.value(t, row) for t in self.trees)

    def sql(self, struct: Column) -> Column:
        """The score of a struct of features as one expression."""
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(struct[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return total


@lru_cache(maxsize=4)
def model(spark: SparkSession) -> tuple[Trees, float]:
    """Trees and their calibrated threshold. A third of the examples is held out; the threshold
    is midway between the highest score of a held-out negative and the lowest of the positives
    above it, so that none of the negatives is taken."""
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples())), TRAIN_SCHEMA))
                                   .alias("e"))
    rows = listed.select("e.label", features(F.col("e.generator"), F.col("e.before"),
                                             F.col("e.body")).alias("f")).collect()
    table = [[r.f[c] for c in FEATURES] for r in rows]
    labels = [r.label for r in rows]
    # examples come in twelves, one of each kind: every third dozen is held out
    train = [i for i in range(len(rows)) if i // 12 % 3]
    trees = Trees([table[i] for i in train], [labels[i] for i in train], ROUNDS, DEPTH, RATE)
    held = [(trees.score(table[i]), labels[i]) for i in range(len(rows)) if i // 12 % 3 == 0]
    worst = max((s for s, y in held if not y), default=0.0)
    above = min((s for s, y in held if y and s > worst), default=worst + 1)
    return trees, (worst + above) / 2


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, keep..., base, added): arrays of (start, kind_no, kind, end), sorted."""
    trees, threshold = model(docs.sparkSession)
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep)

    def span(kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"),
                                  F.lit(kind).alias("kind"), m["end"].alias("end"))

    def valid(kind: str):
        return lambda m: CHECKS[kind](m["body"])

    base = [F.transform(F.filter(found(text, PATTERNS[k]), valid(k)), span(k)) for k in PATTERNS]
    gate = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
    base = [F.when(text.rlike(gate[k]), b).otherwise(none) for k, b in zip(PATTERNS, base, strict=True)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))

    def scored(number: int, kind: str, pattern: str) -> Column:
        described = F.transform(found(text, pattern), lambda m: F.struct(
            span(kind)(m).alias("s"), features(
                F.lit(number), F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1,
                                           F.least(m["start"], F.lit(CONTEXT))),
                m["body"]).alias("f")))
        return F.transform(F.filter(described, lambda c: trees.sql(c["f"]) > threshold),
                           lambda c: c["s"])

    proposed = [F.when(text.rlike("[0-9=]"), scored(k, kind, pattern)).otherwise(none)
                for k, (kind, pattern) in enumerate(GENERATORS.values())]
    rows = rows.withColumn("proposed", F.array_distinct(F.concat(*proposed)))

    def outer(a: Column, x: Column) -> Column:
        """Whether another proposal holds x, the earlier of equal ones."""
        return F.exists(a, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
                        & ((y["end"] - y["start"] > x["end"] - x["start"])
                           | ((y["end"] - y["start"] == x["end"] - x["start"])
                              & (y["kind_no"] < x["kind_no"]))))

    fresh = F.filter("proposed", lambda x: ~F.exists("base", lambda y: (
        y["start"] < x["end"]) & (x["start"] < y["end"])))
    added = let(fresh, lambda a: F.array_sort(F.filter(a, lambda x: ~outer(a, x))))
    return rows.select("doc_id", "text", *keep, "base", F.when(
        F.size("proposed") > 0, added).otherwise(none).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added,
    base_sha256, spans.

    Spans are kind:start:end in code points. Added kinds are `secret` and `number`; they never
    overlap base spans. A null or empty text has no spans. Repeated rows give equal results; an
    empty table gives an empty one. Other columns are not looked at."""
    both = spans_of(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{k}") for k in PATTERNS]
    return both.select("doc_id", *counts, F.size("added").cast("bigint").alias("n_added"),
                       F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets, spans that overlap by the
    first one's. A null text stays null; other columns stay as they are."""
    named = [c for c in docs.columns if c not in (id_col, text_col)]
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *named)
    rest = [F.col(c).alias(f"__{i}") for i, c in enumerate(named)]
    carried = renamed.select("doc_id", "text", *rest, F.isnull("text").alias("__null"))
    both = spans_of(carried, keep=(*[f"__{i}" for i in range(len(named))], "__null"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(
                s["out"], F.substring("text", s["at"] + 1, x["start"] - s["at"]),
                F.lit("<"), x["kind"], F.lit(">"))).alias("out"))

    clean = F.when(F.size("base") + F.size("added") == 0, F.col("text")).otherwise(
        let(F.aggregate(F.array_sort(F.concat("base", "added")), start, step),
            lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text")))))
    back = {c: F.col(f"__{i}") for i, c in enumerate(named)}
    back |= {id_col: F.col("doc_id"), text_col: F.when(~F.col("__null"), clean)}
    return both.select(*[back[c].alias(c) for c in docs.columns])
