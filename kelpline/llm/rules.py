"""Operator 5 [native]: quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row keeps the measurements and one failure bit per rule. A policy
is a versioned bitmask of the rules it applies, so verdicts of any policy version, and ablations (what a policy would
keep without one of its rules), are bitwise operations and sums on the ledger; texts are not read again. Built-in
functions only, one pass, no shuffle.

Repeated windows: a document's three-word windows are hashed; only a document with equal hashes sorts its (hash, place)
pairs and counts the words that repeated windows cover, so a text of n words costs n log n at most.

Edge cases: a null or empty text has no words and fails ``too_few_words``; very long texts are measured whole; repeated
rows give repeated ledger rows; ties do not occur; a null id is kept as null; an empty table gives an empty ledger and
zero sums; only the id and text columns are read. Two different windows of one text share a 64-bit hash with a chance of
about 1e-11 for 20,000 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> failure condition on the measurements; a rule's bit is its place in this order, which never changes.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "few_letters": "2 * n_letters < word_chars",
    "shouting": "10 * n_upper > 5 * n_letters",
    "bullet_lines": "n_lines >= 4 and 10 * n_bullet_lines > 9 * n_lines",
}
#: version -> rules it applies
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "word_length", "symbols"),
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _hashes() -> Column:
    return F.transform("_w", lambda w: F.xxhash64(w))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measurements) of every text."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.select(id_col, "_t", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("_lines"))
    df = df.withColumns({"_h": _hashes(), "n_words": F.size("_w").cast("long")})
    at = lambda i, k: F.get("_h", i + F.lit(k))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    df = df.withColumn("_win", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.filter(F.transform("_sorted", lambda x, k: F.when((x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_places", F.sort_array(places))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    letters = F.regexp_replace("_t", r"[^\p{L}]+", "")
    return df.select(
        id_col,
        "n_words",
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))).cast("long").alias("n_bullet_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failures``, the bitmask of the rules that a document fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failures", total.cast("long"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(policy, without, kept, gained, bits_seen): documents kept when one rule is left out; ``without`` null is the policy itself."""
    rules = POLICIES[policy]
    full = mask(rules)
    kept = [(None, full), *((r, full & ~mask((r,))) for r in rules)]
    sums = rows.agg(*[F.count_if(F.col("failures").bitwiseAND(F.lit(m)) == 0).alias(f"k{i}") for i, (_, m) in enumerate(kept)], F.coalesce(F.bit_or("failures"), F.lit(0)).alias("seen"))
    out = F.explode(F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(r).cast("string").alias("without"), F.col(f"k{i}").alias("kept"), (F.col(f"k{i}") - F.col("k0")).alias("gained"), F.col("seen").bitwiseAND(F.lit(full)).alias("bits_seen")) for i, (r, _) in enumerate(kept)]))
    return sums.select(out.alias("x")).select("x.*")
