"""Quality rules as a bitmask ledger, with DataFrame functions alone.

Every rule is evaluated once. The ledger keeps the measurements and one long of failure bits per document; a policy
is a mask of rules under a version name, so applying a policy, or asking what a rule alone removes, is bit arithmetic
over the ledger and reads no text again.

Null and empty texts have no words, measure 0 and fail ``few_words``. Repeated rows are judged row by row: ``drop_failed`` carries
the rows through the ledger, so no identifier is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the ledger's measurements


#: A bit never changes its meaning: a new rule takes a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "long_words", "word_chars > 14 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
)
BASE = 0b000011
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {"base": BASE, "v1": 0b001111, "v2": 0b111111}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits) of each row.

    Windows are compared as 64-bit hashes, not word by word: two different windows of one text would have to share one."""
    # A window is a 64-bit hash; its leading bits and its place are packed into one long and sorted as primitives, so
    # equal windows become neighbours, whose full hashes are then compared.
    words = F.array_remove(F.split("_text", SPACE), "")
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumns(
        {
            "_words": words,
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        }
    )
    measured = base.select(
        id_col,
        "n_symbols",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(_words) < 4, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
        ).alias("_windows"),
    ).drop("_words")
    # only texts in which some window repeats go on: the others have as many distinct windows as windows
    packed = measured.withColumn("_bits", F.expr("if(size(array_distinct(_windows)) = size(_windows), 0, length(bin(size(_windows))))")).withColumn(
        "_packed",
        F.expr(
            "if(_bits = 0, array(), sort_array(transform(_windows, (h, i) -> shiftleft(shiftrightunsigned(h, _bits), _bits) | cast(i as long))))"
        ),
    )
    # both places of each pair of equal neighbours, in the order of the text
    places = packed.withColumn(
        "_places",
        F.expr(
            """if(_bits = 0, array(), sort_array(array_distinct(flatten(transform(
                 filter(sequence(1, size(_packed) - 1), i ->
                   shiftrightunsigned(_packed[i], _bits) = shiftrightunsigned(_packed[i - 1], _bits)
                   and _windows[cast(_packed[i] & (shiftleft(1L, _bits) - 1) as int)] = _windows[cast(_packed[i - 1] & (shiftleft(1L, _bits) - 1) as int)]),
                 i -> array(cast(_packed[i - 1] & (shiftleft(1L, _bits) - 1) as int), cast(_packed[i] & (shiftleft(1L, _bits) - 1) as int)))))))"""
        ),
    )
    counted = places.withColumn(
        "n_repeat_words",
        F.expr(
            """if(size(_places) = 0, 0L, 3L + aggregate(sequence(1, greatest(size(_places) - 1, 1)), 0L,
                 (a, i) -> a + if(i < size(_places), cast(least(3, _places[i] - _places[i - 1]) as long), 0L)))"""
        ),
    )
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    measures = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # the generator is a fence: a filter over the ledger must not be pushed down as copies of the expressions above
    fenced = counted.select(id_col, F.inline(F.array(F.struct(*measures))))
    return fenced.withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add base_failed and kept: a document is kept if no rule of the policy failed it, and the base did not."""
    mask = POLICIES[policy] | BASE
    return rows.withColumns({"base_failed": F.expr(f"(fail_bits & {BASE}L) <> 0"), "kept": F.expr(f"(fail_bits & {mask}L) = 0")})


def drop_failed(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with all their columns."""
    carried = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_content"))
    return apply_policy(ledger(carried, "_row", "_content"), policy).where("kept").select("_row.*")


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """One row per policy and rule in it: documents the rule fails, those the policy rejects, and those that only this rule
    rejects (kept if the rule were left out). One aggregation over the ledger's bits, pre-summed in each task."""
    policies = POLICIES if policies is None else policies
    grouped = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    sums, keys = [], []
    for version, mask in policies.items():
        for r in RULES:
            if mask >> r.bit & 1:
                keys.append((version, r.name))
                k = len(keys) - 1
                sums += [
                    F.expr(f"coalesce(sum(if((fail_bits & {1 << r.bit}L) <> 0, n, 0)), 0)").alias(f"f{k}"),
                    F.expr(f"coalesce(sum(if((fail_bits & {mask}L) <> 0, n, 0)), 0)").alias(f"r{k}"),
                    F.expr(f"coalesce(sum(if((fail_bits & {mask}L) = {1 << r.bit}L, n, 0)), 0)").alias(f"o{k}"),
                ]
    if not keys:
        raise ValueError("no policy names a rule")
    row = "array(" + ", ".join(f"struct('{v}' as policy, '{n}' as rule, f{k} as n_failed, r{k} as n_rejected, o{k} as n_only)" for k, (v, n) in enumerate(keys)) + ")"
    return grouped.agg(*sums).select(F.inline(F.expr(row)))
