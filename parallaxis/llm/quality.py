"""Rule bitmask ledger for document quality, in DataFrame functions only.

`ledger` measures each text once and evaluates every rule once: it stores the measurements and one long whose bit i
says that rule i failed. Policies are versioned masks over those bits: `apply_policy` decides, and `ablation` counts by
bitwise aggregation what each rule alone is responsible for, without touching a text again.

Words are `[^\\x20\\x09-\\x0D]+`. Results for odd input: a null text counts as empty; a text without words has zero for
all measurements and fails `few_words`; equal rows get equal results; an empty table gives an empty ledger; other
columns of the input are dropped by `ledger` and kept by `clean`, whose own columns start with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column) -> tuple[list[Column], list[str]]:
    """Stages of named columns: each stage may use the columns of those before it."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+$", "")
    first = {
        "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
    }
    words = F.col("__words")
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    n = F.size(words)
    second = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hashes": hashes,
    }
    h = F.col("__hashes")
    third = {
        "__windows": F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        )
    }
    w = F.col("__windows")
    # places of windows that stand twice or more: neighbours in the order of (window, place)
    ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    fourth = {"__ranked": F.when(F.size(w) > F.size(F.array_distinct(w)), ranked)}
    r = F.col("__ranked")
    twice = F.filter(r, lambda x, i: (x["w"] == F.get(r, i + 1)["w"]) | ((i > 0) & (x["w"] == F.get(r, i - 1)["w"])))
    fifth = {"__places": F.array_sort(F.transform(twice, lambda x: x["i"]))}
    p = F.col("__places")
    sixth = {
        "n_repeat_words": F.coalesce(
            F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")
            ),
            F.lit(0).cast("long"),
        )
    }
    return [first, second, third, fourth, fifth, sixth]


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits are never given anew: a rule that changes gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 4 * n_words"),
    Rule(3, "duplicate_lines", "3 * n_dup_lines > n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)

#: version: rules that reject
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}
VERSION = 2


def mask_of(version: int, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in POLICIES[version])


def _measured(docs: DataFrame, text: str) -> DataFrame:
    out = docs
    for stage in measures(F.col(text)):
        out = out.withColumns(stage)
    return out


def _failed(rules: tuple[Rule, ...]) -> Column:
    """The failure bits.

    The second part is always 0, but not deterministic to the optimizer: filters on the bits stay above the
    measurements, instead of being pushed below with a copy of the whole computation for each use.
    """
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in rules)
    return F.expr(bits).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(0)))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the five measurements, failed long): bit i of failed is set if rule i failed."""
    return _measured(docs.select("doc_id", "text"), "text").select("doc_id", *MEASURES).withColumn("failed", _failed(rules))


def apply_policy(entries: DataFrame, version: int = VERSION) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(version))) == 0)


def ablation(entries: DataFrame, version: int = VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_only): rows that fail each rule of a policy, and rows that only this rule rejects."""
    mask = mask_of(version, rules)
    sums = []
    own = [r for r in rules if mask >> r.bit & 1]
    for r in own:
        bit = F.lit(1 << r.bit)
        masked = F.col("failed").bitwiseAND(F.lit(mask))
        sums += [F.count(F.when(masked.bitwiseAND(bit) != 0, 1)).alias(f"f{r.bit}"), F.count(F.when(masked == bit, 1)).alias(f"o{r.bit}")]
    total = entries.agg(*sums)
    row = F.array(*[F.struct(F.lit(version).alias("version"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in own])
    return total.select(F.inline(row))


def clean(docs: DataFrame, version: int = VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__text"))
    out = _measured(packed, "__text").withColumn("failed", _failed(rules))
    return apply_policy(out, version).where("kept").select("__row.*")


def verdicts(docs: DataFrame, version: int = VERSION) -> DataFrame:
    """The ledger with base_failed (the first two rules) and the policy's verdict."""
    base = mask_of(1)
    return apply_policy(ledger(docs), version).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0).select("doc_id", *MEASURES, "base_failed", "kept", "failed")
