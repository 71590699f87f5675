"""License scans by ordered signature rules, in DataFrame functions only.

A text is normalised to words. Its keywords choose which rules are tried at all, each rule's places become intervals of
words, and an interval that lies inside one of a stronger rule, or inside a longer one of an equally strong rule, is
suppressed. Base phrases are counted apart and are never suppressed.

A text may hold any number of matches: places are read off the words of the text, where marks stand around the matches,
and suppression is a running maximum over the sorted intervals, made in log2(n) passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.license_rules import PROPRIETARY, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are counted, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
OPEN, CLOSE = "\x01", "\x02"  # marks around a match; no normalised text holds them
LEVELS = range(5)  # priorities: 0 is a base phrase
_SHIFT = 1 << 32


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule(regex: str, label: str, priority: int, confidence: float) -> str:
    return (
        f"named_struct('regex', {_sql(regex)}, 'label', {_sql(label)}, "
        f"'priority', {priority}, 'confidence', {confidence}D)"
    )


def rule_groups() -> Column:
    """array<struct<keywords, licen, rules: array<struct<regex, label, priority, confidence>>>>, a constant of the plan."""
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for r in rules():
        rule = _rule(r["regex"], r["label"], r["priority"], r["confidence"])
        groups.setdefault((r["keywords"], r["licen"]), []).append(rule)
    parts = [
        f"named_struct('keywords', array({', '.join(map(_sql, k))}), 'licen', {str(licen).lower()}, 'rules', array({', '.join(v)}))"
        for (k, licen), v in groups.items()
    ]
    return F.expr(f"array({', '.join(parts)})")


def base_rules() -> Column:
    return F.expr(
        "array("
        + ", ".join(
            f"named_struct('phrase', {_sql(p)}, 'rule', {_rule(f'(?<![^ ]){p}(?![^ ])', label, 0, 1.0)})"
            for p, label in BASE.items()
        )
        + ")"
    )


def normal_words(text: Column) -> Column:
    """A-Z lower-cased; every run of other characters than digits, letters and non-ASCII is one space; trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(normal: Column, rule: Column) -> Column:
    """Where a rule matches: array<struct<first, last, label, priority, confidence>>, in words from 0."""

    def where(words: Column, marked: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(marked(w), i)), lambda i: i.isNotNull())

    def spans(words: Column) -> Column:
        return F.zip_with(
            where(words, lambda w: F.startswith(w, F.lit(OPEN))),
            where(words, lambda w: F.endswith(w, F.lit(CLOSE))),
            lambda first, last: F.struct(
                first.alias("first"),
                last.alias("last"),
                rule["label"].alias("label"),
                rule["priority"].alias("priority"),
                rule["confidence"].alias("confidence"),
            ),
        )

    marked = F.regexp_replace(normal, rule["regex"], F.lit(f"{OPEN}$0{CLOSE}"))
    # without a match there is nothing to split
    words = lambda m: F.when(F.contains(m, F.lit(OPEN)), F.split(m, " ", -1)).otherwise(F.array().cast("array<string>"))
    return let(marked, lambda m: let(words(m), spans))


def unsuppressed(found: Column) -> Column:
    """The distinct detections of ``found`` that no other suppresses, without the base phrases.

    Suppressed is what lies in a detection that is stronger, or as strong and longer. Sorted by start, longer first, then
    stronger, such a detection stands before it, so the farthest end so far (and its earliest start) by priority decides.
    """

    def key(d: Column) -> Column:  # larger: ends later, or starts earlier and ends at the same word
        return d["last"].cast("long") * _SHIFT - d["first"]

    def farthest(sorted_: Column) -> Column:
        own = F.transform(
            sorted_, lambda d: F.struct(*(F.when(d["priority"] <= p, key(d)).alias(f"p{p}") for p in LEVELS))
        )
        passes = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(sorted_), F.lit(2)))).cast("int"))
        steps = F.transform(F.sequence(F.lit(0), passes - 1), lambda k: F.pow(F.lit(2), k).cast("int"))

        def joined(state: Column, step: Column) -> Column:
            return F.transform(
                state,
                lambda x, i: let(
                    F.get(state, i - step),
                    lambda y: F.struct(*(F.greatest(x[f"p{p}"], y[f"p{p}"]).alias(f"p{p}") for p in LEVELS)),
                ),
            )

        return F.aggregate(steps, own, joined)

    def suppressed(d: Column, far: Column) -> Column:
        at = F.array(*(far[f"p{p}"] for p in LEVELS))
        stronger = F.get(at, d["priority"] - 1) > (d["last"].cast("long") - 1) * _SHIFT
        return F.coalesce(stronger, F.lit(False)) | (F.get(at, d["priority"]) > key(d))

    def survivors(sorted_: Column) -> Column:
        marked = F.zip_with(
            sorted_, farthest(sorted_), lambda d, far: F.struct(d.alias("d"), suppressed(d, far).alias("gone"))
        )
        kept = F.filter(marked, lambda m: ~m["gone"] & (m["d"]["priority"] > 0))
        return F.transform(kept, lambda m: m["d"].dropFields("back"))

    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["first"].alias("first"),
                (-d["last"]).alias("back"),
                d["priority"].alias("priority"),
                d["label"].alias("label"),
                d["last"].alias("last"),
                d["confidence"].alias("confidence"),
            ),
        )
    )
    distinct = lambda o: F.filter(o, lambda d, i: (i == 0) | (d != F.get(o, i - 1)))
    return F.when(F.size(found) > 0, let(ordered, lambda o: let(distinct(o), survivors)))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections; one row per document.

    ``detections`` are the intervals that are left; ``labels`` their labels and the base ones, distinct, sorted and
    joined by commas; ``score`` is the highest confidence, 1 for any base phrase, 0 without a detection. "All rights
    reserved" counts only in a text without any other detection, since license headers say it too.

    A null or empty text has no words; first_word and last_word are null without a base phrase. Equal intervals of equal
    priority (ties) are all kept, and one that two rules of a label find counts once. Ids, repeated rows and other columns
    are not looked at; an empty table gives an empty result. Whole texts are scanned; rules run only where one of their
    keywords occurs.
    """
    groups, base = rule_groups(), base_rules()
    keywords = F.array(*(F.lit(k) for k in dict.fromkeys(k for r in rules() for k in r["keywords"])))
    # generators keep what follows one column each, so that no rule computes it again
    normal = F.explode(F.array(normal_words(F.coalesce(F.col("text"), F.lit(""))))).alias("normal")
    scanned = docs.select("doc_id", normal)
    hits = F.array_intersect(F.split("normal", " ", -1), keywords)
    scanned = scanned.select("doc_id", "normal", F.explode(F.array(hits)).alias("hits"))
    scanned = scanned.withColumn("licen", (F.size("hits") > 0) & F.contains("normal", F.lit("licen")))
    chosen = F.filter(groups, lambda g: (F.col("licen") | ~g["licen"]) & F.arrays_overlap(F.col("hits"), g["keywords"]))
    rules_in = F.flatten(F.transform(F.when(F.size("hits") > 0, chosen).otherwise(F.array()), lambda g: g["rules"]))
    found = F.flatten(F.transform(rules_in, lambda r: places(F.col("normal"), r)))
    base_in = F.filter(base, lambda b: (F.size("hits") > 0) & F.contains(F.col("normal"), b["phrase"]))
    base_found = F.flatten(F.transform(base_in, lambda b: places(F.col("normal"), b["rule"])))
    scanned = scanned.select(
        "doc_id",
        F.when(F.col("normal") == "", 0).otherwise(spaces(F.col("normal")) + 1).cast("long").alias("n_words"),
        F.explode(F.array(F.struct(found.alias("found"), base_found.alias("base")))).alias("d"),
    )
    kept = F.coalesce(unsuppressed(F.concat("d.found", "d.base")), F.array())
    fields = ["first", "last", "label", "priority", "confidence"]
    same = lambda found: F.transform(found, lambda p: F.struct(*(p[f].alias(f) for f in fields)))
    scanned = scanned.select(
        "doc_id",
        "n_words",
        F.explode(F.array(F.struct(same(F.col("d.base")).alias("base"), same(kept).alias("kept")))).alias("d"),
    )
    other = (F.size("d.base") > 0) | F.exists("d.kept", lambda p: p["label"] != PROPRIETARY)
    scanned = scanned.select(
        "doc_id",
        "n_words",
        F.col("d.base").alias("base"),
        F.filter("d.kept", lambda p: (p["label"] != PROPRIETARY) | ~other).alias("kept"),
    )
    labels = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"])))
    every = F.concat("base", "kept")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["first"])).cast("long").alias("last_word"),
        F.array_join(labels(F.col("base")), ",").alias("base_labels"),
        F.array_join(labels(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda p: p["confidence"])), F.lit(0.0)).alias("score"),
        every.alias("detections"),
    )
