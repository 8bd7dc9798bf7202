"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and a
mask with one bit for each rule the document fails. A policy is a named, versioned
mask of the rules it applies: a document is kept if none of its failed bits is in
the mask. Changing or comparing policies, and asking what each rule costs, needs the
masks alone, which are counted per distinct value before anything else.

All limits are fractions in whole numbers, so that no verdict hangs on rounding.

Null and empty texts have no words; they fail ``few_words`` alone. Rows with null or
repeated ids are measured like any other. Very long texts are measured whole. A
measurement at a limit keeps the document. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import slices, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Rule(NamedTuple):
    """Fails where ``fails`` holds; ``sql`` says the same for people and other engines."""

    name: str
    sql: str

    @property
    def fails(self) -> Column:
        return F.expr(self.sql)


#: The place of a rule is its bit: append, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("exclamations", "4 * n_exclamations > n_words"),
)


def mask(names: Iterable[str]) -> int:
    places = {rule.name: place for place, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


#: Policies by name and version; published versions stay as they are.
POLICIES = {
    "base.1": mask(["few_words", "repeated_words"]),
    "web.1": mask(["few_words", "repeated_words", "symbols", "duplicate_lines"]),
    "web.2": mask(rule.name for rule in RULES),
}


def _repeated_places(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words inside three-word windows that the text has more than once."""
    counts = np.diff(starts)
    if len(hashes) < 3:
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    window = (hashes[:-2] * _STEP + hashes[1:-1]) * _STEP + hashes[2:]
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    key, of = window[inside], owner[inside]
    order = np.lexsort((key, of))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    at = inside[order[twice]]
    for step in range(3):
        covered[at + step] = True
    return np.bincount(owner[covered], minlength=len(counts))


def _measured(texts: list[str | None]) -> pd.DataFrame:
    words, starts = words_of(texts)
    texts = [text or "" for text in texts]
    lines = [text.split("\n") for text in texts]
    filled = [[line for line in each if line.strip(BLANKS)] for each in lines]
    return pd.DataFrame({
        "n_words": np.diff(starts),
        "word_chars": [len(text) - sum(map(text.count, BLANKS)) for text in texts],
        "n_symbols": [sum(map(text.count, SYMBOLS)) for text in texts],
        "n_dup_lines": [len(each) - len(set(each)) for each in filled],
        "n_repeat_words": _repeated_places(starts, word_hashes(words)),
        "n_lines": list(map(len, filled)),
        "n_exclamations": [text.count("!") for text in texts],
    }, dtype="int64")


def measures(text: Column) -> Column:
    """What the rules need to know of each text, as a struct."""

    @F.pandas_udf(", ".join(f"{name} long" for name in MEASURES))
    def measure(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        parts = [_measured(values[begin:end]) for begin, end in slices(values)]
        return pd.concat(parts, ignore_index=True) if parts else _measured([])

    return measure(text)


def ledger(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, all measurements, and ``failed``: bit i is set where rule i fails."""
    measured = documents.select(F.col(doc_id).alias("doc_id"), measures(F.col(text)).alias("_m")).select("doc_id", "_m.*")
    bits = [F.when(rule.fails, F.lit(1 << place)).otherwise(0) for place, rule in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("int"))


def kept(policy: int, failed: Column | None = None) -> Column:
    """Whether a document with these failed bits passes the policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy)) == 0


def ablations(entries: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """What each rule costs under each policy.

    One row per policy and rule in it: ``failing`` documents, ``only`` (those that no
    other rule of the policy rejects: dropping the rule would bring them back) and
    ``kept`` by the policy as it is. The ledger is counted per distinct mask first.
    """
    masks = entries.groupBy("failed").agg(F.count("*").alias("documents"))
    columns, names = [], []
    for policy, bits in policies.items():
        under = F.col("failed").bitwiseAND(F.lit(bits))
        for place, rule in enumerate(RULES):
            if bits >> place & 1:
                sums = [F.sum(F.when(test, F.col("documents")).otherwise(0)) for test in
                        (under.bitwiseAND(F.lit(1 << place)) != 0, under == (1 << place), under == 0)]
                columns.append(F.struct(F.lit(policy).alias("policy"), F.lit(rule.name).alias("rule"),
                                        *[F.coalesce(value, F.lit(0)).cast("long").alias(name)
                                          for value, name in zip(sums, ("failing", "only", "kept"), strict=True)]))
                names.append((policy, rule.name))
    return masks.agg(F.array(*columns).alias("_rows")).select(F.inline("_rows"))
