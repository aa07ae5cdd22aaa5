"""Problem 4: repetition inside a document, judged by a learned decision list.

Every text gets a row of statistics. The list is learned from a bounded sample of rows labelled by the definition, which is none of the
statistics: sequential covering grows a conjunction of thresholds, prunes it on held-out rows, removes what it covers and goes on; the rules become one
ordered Spark conditional. Its last rule isn't learned: it holds for whatever the definition can hold for, so that the list loses no
row, whatever the sample had. Rows on which a rule fires are checked against the definition itself.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import batched, bounded_sample
from tapeloom.llm.words import RUN, hashed, runs_of, words
from tapeloom.plans.stage import staged

LEAST_WORDS, SHARE = 30, 0.25
#: Labelled rows that the list is learned from, at most: those with the least hash of their key.
TRAINING_ROWS = 20_000
STATISTICS = ("n_words", "line_repeats", "sentence_repeats", "pair_repeats", "top_pair", "squeeze")
#: The shares that are reported and that the definition is about; the list doesn't see them.
SHARES = ("run_repeats", "long_repeats")
_SCHEMA = "pos long, " + ", ".join(f"{s} double" for s in STATISTICS + SHARES)
_PART = re.compile(r"[.!?…。！？।؟\r\n]+")


def _repeats(values: np.ndarray) -> float:
    """The share of the values that repeat an earlier one."""
    return 1 - len(np.unique(values)) / len(values) if len(values) else 0.0


def _share(parts: list[str]) -> float:
    kept = [p for p in map(str.strip, parts) if p]
    return 1 - len(set(kept)) / len(kept) if kept else 0.0


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS and SHARES for a text; all 0 for NULL, empty and blank ones."""
    tokens = words(text)
    if not tokens:
        return [0.0] * len(STATISTICS + SHARES)
    h = hashed(tokens)
    pairs = h[:-1] * np.uint64(31) + h[1:]
    kinds, counts = np.unique(pairs, return_counts=True)
    runs = runs_of(h)
    wide = runs[:-RUN] * np.uint64(31) + runs[RUN:] if len(runs) > RUN else runs[:0]
    raw = text.encode()
    return [
        float(len(tokens)),
        _share(text.splitlines()),
        _share(_PART.split(text)),
        1 - len(kinds) / len(pairs) if len(pairs) else 0.0,
        float(counts.max() / len(pairs)) if len(pairs) else 0.0,
        1 - len(zlib.compress(raw, 1)) / len(raw),
        _repeats(runs),
        _repeats(wide),
    ]


@dataclass(frozen=True)
class Rule:
    """Thresholds that hold together: (statistic, whether it must be at least, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        kept = np.ones(len(x), dtype=bool)
        for name, least, at in self.tests:
            column = x[:, STATISTICS.index(name)]
            kept &= column >= at if least else column < at
        return kept

    def condition(self) -> Column:
        said = F.lit(True)
        for name, least, at in self.tests:
            said = said & (F.col(name) >= at if least else F.col(name) < at)
        return said

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if least else '<'} {at:.4g}" for name, least, at in self.tests)


def _best_test(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> tuple[float, tuple[str, bool, float]] | None:
    """The threshold that raises the weight of evidence most over the rows still kept, by FOIL's gain.

    A threshold lies at the outermost positive value itself, not midway to the negatives beyond: nothing is known between them.
    """
    p, n = int(y[kept].sum()), int((~y[kept]).sum())
    if not p or not n:
        return None
    base, best = np.log2(p / (p + n)), None
    for k, name in enumerate(STATISTICS):
        order = np.argsort(x[kept, k], kind="stable")
        v, pos = x[kept, k][order], y[kept][order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        below_p, below_n = np.concatenate([[0], np.cumsum(pos)])[first], np.concatenate([[0], np.cumsum(~pos)])[first]
        for least, ps, ns in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - base), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                at = float(v[first[i]])
                if least:  # down to just above the highest value that the threshold shuts out
                    at = float(np.nextafter(v[first[i] - 1], np.inf)) if first[i] else at
                best = (float(gain[i]), (name, least, at))
    return best


def learned(x: np.ndarray, y: np.ndarray, most_rules: int = 8, most_tests: int = 4) -> list[Rule]:
    """The rules, in order, for the rows ``x`` of STATISTICS labelled ``y``. Every third row is kept for pruning."""
    rules: list[Rule] = []
    grow = np.arange(len(x)) % 3 != 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and y[left].any():
        tests: list[tuple[str, bool, float]] = []
        kept = left.copy() if not y[left & grow].any() else left & grow
        while len(tests) < most_tests and (found := _best_test(x, y, kept)):
            tests.append(found[1])
            kept = kept & Rule((found[1],)).holds(x)
        held = left & ~grow

        def worth(rule: tuple) -> float:
            covered = Rule(rule).holds(x) & held
            p, n = int((covered & y).sum()), int((covered & ~y).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tuple(tests[:-1])) >= worth(tuple(tests)):
            tests.pop()
        if not tests:
            break
        rule = Rule(tuple(tests))
        covered = rule.holds(x) & left
        if not (covered & y).any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def conditional(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, from 1; 0 where none does."""
    said = None
    for i, rule in enumerate(rules, 1):
        said = F.when(rule.condition(), i) if said is None else said.when(rule.condition(), i)
    return F.lit(0) if said is None else said.otherwise(0)


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row of STATISTICS and SHARES for every row with a key; repeated rows count once, of several texts of a key the more repetitive counts."""
    every = STATISTICS + SHARES

    def rows(ids: list[int], texts: list[str | None]) -> list[list]:
        return [ids, *(list(c) for c in zip(*map(statistics, texts)))] if ids else [[] for _ in range(len(every) + 1)]

    made = batched(df.select(F.col(key).cast("long").alias("pos"), F.col(text).alias("text")).where("pos IS NOT NULL"), _SCHEMA, rows)
    return made.groupBy("pos").agg(F.max(F.struct("run_repeats", *(s for s in every if s != "run_repeats"))).alias("s")).select("pos", *(f"s.{s}" for s in every))


def _defined() -> Column:
    return (F.col("n_words") >= LEAST_WORDS) & (F.col("run_repeats") >= SHARE - 1e-12)


def _possible() -> Column:
    """Whether the definition can hold: where a run repeats an earlier one its first two words repeat an earlier pair, so a text has as many repeated pairs as runs, or more."""
    return (F.col("n_words") >= LEAST_WORDS) & (F.col("pair_repeats") * (F.col("n_words") - 1) >= SHARE * (F.col("n_words") - RUN + 1) - 1e-6)


def judged(df: DataFrame, key: str = "pos", text: str = "text", sample: int = TRAINING_ROWS) -> DataFrame:
    """(pos, STATISTICS..., SHARES..., rule, listed, repetitive): the repeated share of every text, the rule that fired, and the verdict.

    ``rule`` is the first learned rule that holds, -1 where only the last one does, 0 where none does; ``listed`` is what the learned rules alone say.
    ``repetitive`` holds where a rule fired and the definition does: at least 30 words and a quarter of the runs repeating earlier ones.
    ``run_repeats`` is the share of runs that do, ``long_repeats`` that of ten words. NULL, empty and blank texts have
    statistics of 0 and aren't repetitive.
    """
    stats = staged(measured(df, key, text), "statistics")
    rows = bounded_sample(stats.withColumn("y", _defined()), "pos", sample)
    x = np.array([[r[s] for s in STATISTICS] for r in rows], dtype=float).reshape(-1, len(STATISTICS))
    rules = learned(x, np.array([r["y"] for r in rows], dtype=bool))
    fired = conditional(rules)
    seen = stats.withColumn("rule", F.when(fired > 0, fired).when(_possible(), -1).otherwise(0))
    return seen.withColumn("listed", F.col("rule") > 0).withColumn("repetitive", (F.col("rule") != 0) & _defined())


def by_rule(rows: DataFrame) -> DataFrame:
    """(rule, texts, repetitive, mean_share): of the rows of ``judged`` on which each rule fired, how many the definition calls repetitive."""
    yes = F.count(F.when(F.col("repetitive"), 1)).alias("repetitive")
    return rows.groupBy("rule").agg(F.count("*").alias("texts"), yes, F.avg("run_repeats").alias("mean_share"))
