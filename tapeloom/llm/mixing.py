"""Problem 9: mixing sources to target weights by temperature.

A source that can hold its target share does; one that cannot gives all it has, each document as often as allowed. What is then lacking is
shared out by the sources' token shares, raised to an exponent and normalised, within the same repetition limits. The exponent
is bisected until the mix has the entropy of the targets. The weights become uses: a source's documents are permuted by hash
in blocks, whole passes are taken while the budget lasts, and one pass is cut where the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.rows import batched
from tapeloom.plans.prefix import running_sum
from tapeloom.plans.stage import staged
from tapeloom.sources import tokenizers

#: Blocks that a source's permuted documents are cut into for running sums. A block holds that part of a source in one task.
BLOCKS = 4096
#: Target rows are collected; more than so many are refused.
MOST_SOURCES = 100_000


def source_name(c: str) -> Column:
    """A source's name without blanks at the ends and in lower case; blank names are NULL."""
    low = F.lower(F.trim(c))
    return F.when(low != "", low)


def token_counts(docs: DataFrame, folder: str = tokenizers.FOLDER, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens): GPT-2 tokens of every document with a source. NULL and empty texts have none.

    Rows with a NULL key are left out. Repeated rows count once; of several texts or sources of a key the one with the most tokens counts.
    """

    def count(ids: list[int], names: list[str], texts: list[str | None]) -> list[list]:
        encoding = tokenizers.gpt2(folder)
        return [ids, names, [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]]

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND source IS NOT NULL")
    made = batched(rows, "doc_id long, source string, tokens long", count)
    return made.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("s")).select("doc_id", "s.source", "s.tokens")


@dataclass(frozen=True)
class Target:
    """What a source is to have, what it has, and how often a document of it may be used."""

    source: str
    share: float
    tokens: int
    most: int

    def room(self, total: float) -> float:
        """The share of ``total`` that all its documents reach at their most uses."""
        return self.tokens * self.most / total if total else 0.0

    def reaches(self, total: float) -> bool:
        return self.tokens * self.most >= self.share * total


def _tempered(targets: list[Target], exponent: float) -> list[float]:
    """The sources' shares of all their tokens to the power ``exponent``, normalised; sources without tokens or target have none."""
    all_ = sum(t.tokens for t in targets) or 1
    raw = [(t.tokens / all_) ** exponent if t.tokens and t.share > 0 else 0.0 for t in targets]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def _entropy(amounts: list[float]) -> float:
    total = sum(amounts)
    return -sum(a / total * math.log(a / total) for a in amounts if a > 0)


def budgets(targets: list[Target], total: float, exponent: float) -> dict[str, float]:
    """Tokens of each source in a mix of ``total``.

    Each source gets its target, or all it has at its most uses. What is lacking then is shared out among those with room by their
    tempered token shares, again up to their room. If no source has room the mix stays under ``total``.
    """
    given = {t.source: min(t.share * total, float(t.tokens * t.most)) for t in targets}
    left = sum(t.share for t in targets) * total - sum(given.values())
    open_ = [(t, w) for t, w in zip(targets, _tempered(targets, exponent)) if w > 0]
    while left > 1e-6:
        open_ = [(t, w) for t, w in open_ if t.tokens * t.most - given[t.source] > 1e-6]
        mass = sum(w for _, w in open_)
        if not open_ or mass <= 0:
            break
        # The first source to be full bounds the step that all take together.
        step = min(left, min((t.tokens * t.most - given[t.source]) * mass / w for t, w in open_))
        for t, w in open_:
            given[t.source] += step * w / mass
        left -= step
    return given


def exponent_for(targets: list[Target], total: float, entropy: float | None = None) -> float:
    """The exponent of [0, 8] at which the mix has ``entropy``, by default that of the targets: bisected, as more makes the mix less even.

    The nearest end where no exponent reaches it; 1 where the exponent changes nothing.
    """
    wanted = _entropy([t.share for t in targets]) if entropy is None else entropy
    at = lambda x: _entropy(list(budgets(targets, total, x).values()))
    low, high = 0.0, 8.0
    if abs(at(low) - at(high)) < 1e-12:
        return 1.0
    if at(low) <= wanted or at(high) >= wanted:
        return low if at(low) <= wanted else high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle) >= wanted else (low, middle)
    return low


def targets_of(counts: DataFrame, mix: DataFrame) -> tuple[list[Target], int, dict[str, str]]:
    """The targets with their tokens, the tokens of all documents with a source, and each source's name as the table writes it.

    Of a source that the table has several times the first by share counts; rows without a source or share are ignored, a NULL or negative ``max_repeats`` is 0.
    """
    rows = mix.where("source IS NOT NULL AND target_share IS NOT NULL").select("source", source_name("source").alias("name"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("long").alias("most"))
    named = rows.where("name IS NOT NULL").orderBy("share", "source").limit(MOST_SOURCES + 1).collect()
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    first = {r.name: r for r in reversed(named)}
    tokens = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    wanted = mix.select(source_name("source").alias("source")).where("source IS NOT NULL").distinct()
    held = {r.source: r.tokens for r in tokens.join(F.broadcast(wanted), "source", "left_semi").collect()}
    targets = [Target(n, max(0.0, r.share), held.get(n, 0), r.most) for n, r in sorted(first.items())]
    return targets, total, {n: r.source for n, r in first.items()}


def uses(counts: DataFrame, targets: list[Target], given: dict[str, float], seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document of a source with a target is used, none more than its most."""
    spark = counts.sparkSession
    passes, rest = {}, {}
    for t in targets:
        whole = min(t.most, int(given[t.source] // t.tokens)) if t.tokens else 0
        passes[t.source], rest[t.source] = whole, (given[t.source] - whole * t.tokens if whole < t.most else 0.0)
    plan = spark.createDataFrame([(s, passes[s], float(rest[s])) for s in passes], "source string, passes int, rest double")
    rows = counts.join(F.broadcast(plan), "source")
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.withColumn("_order", order).withColumn("_block", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(BLOCKS)))
    summed = running_sum(rows, "_block", [F.col("_order"), F.col("doc_id")], "tokens", "_sum", within=["source"])
    # The last pass takes documents while at least half of the next still fits, so that the budget is met as nearly as whole documents allow.
    more = (F.col("_sum") - F.col("tokens") / 2 < F.col("rest")).cast("int")
    return summed.select("doc_id", "source", "tokens", (F.col("passes") + more).alias("uses"))


def mixed(docs: DataFrame, mix: DataFrame, entropy: float | None = None, total: int | None = None, folder: str = tokenizers.FOLDER) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) for a mix of ``total`` tokens, by default as many as all documents with a source have.

    uses (doc_id, source, tokens, uses): every document of a source with a target. shares (source, target_share, max_repeats,
    tokens, used_tokens, share, reaches): what each target got; ``reaches`` is false where all its documents at their most uses fall short.
    """
    counts = staged(token_counts(docs, folder), "token_counts")
    targets, whole, written = targets_of(counts, mix)
    total = whole if total is None else total
    given = budgets(targets, total, exponent_for(targets, total, entropy))
    used = staged(uses(counts, targets, given), "uses")
    # What the mix gives a source falls short of its target; that its tokens can't do more is the check.
    rows = [(t.source, written[t.source], t.share, t.most, t.tokens, given[t.source] >= t.share * total or t.reaches(total)) for t in targets]
    wanted = docs.sparkSession.createDataFrame(rows, "name string, source string, target_share double, max_repeats long, tokens long, reaches boolean")
    sums = used.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    all_used = sums.agg(F.sum("used_tokens")).first()[0] or 0
    shares = wanted.join(sums, "name", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    shares = shares.withColumn("share", F.col("used_tokens") / F.lit(float(max(all_used, 1))))
    return used, shares.select("source", "target_share", "max_repeats", "tokens", "used_tokens", "share", "reaches")
