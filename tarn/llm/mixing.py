"""Problem 8: a corpus in which each source has its target share of all tokens.

Every record is repeated Poisson(rate) times, cut at its source's cap; the rate is solved so that
the mean after the cut is the wanted repetition. The Poisson variate comes from inverting the
distribution at a hash of the record, so a rerun gives the same corpus. Records are exploded by
their count and spread by a hash of record and copy, which shuffles them.

The corpus is tokenized once a call; what else is asked of it reads the stored sizes. A source that
can't reach its share shows in the replication itself: each of its records stands at its cap and its
tokens are still below the share.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.bpe import TOKENIZER_DIR, VOCABULARY, token_ids
from tarn.plans.session import stored

SEED = 17
TAIL = 12.0  # standard deviations of a Poisson variate beyond which its distribution is 0 or 1 in floats
_RECORD = ("doc_id", "source_key", "h")


def source_key(source: Column | str) -> Column:
    """Source names compare trimmed and in lower case."""
    col = F.col(source) if isinstance(source, str) else source
    return F.lower(F.regexp_replace(col, r"^(?U)\s+|(?U)\s+$", ""))


def targets(mix_targets: DataFrame) -> DataFrame:
    """source, source_key, weight, max_repeats, once a source. Rows with a null source, a null or
    non-positive weight or a null cap want nothing and are left out. Where one source has several
    rows, the one of the largest weight holds, then the largest cap, then the first spelling."""
    own = mix_targets.select("source", source_key("source").alias("source_key"), "weight", "max_repeats").where(
        F.col("source").isNotNull() & (F.col("weight") > 0) & F.col("max_repeats").isNotNull()
    )
    best = F.min(F.struct((-F.col("weight")).alias("w"), (-F.col("max_repeats").cast("long")).alias("m"), "source", "weight", "max_repeats")).alias("best")
    return own.groupBy("source_key").agg(best).select("best.source", "source_key", "best.weight", "best.max_repeats")


def sized(documents: DataFrame, mix_targets: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source_key, h (hash of the text), n_tokens of every document of a target's source,
    once each, stored: the one pass of the tokenizer that budgets, draws and shares read.

    mix_targets is a table of fixed size, so it is broadcast. Null and empty texts have 0 tokens.
    """
    wanted = F.broadcast(targets(mix_targets).select("source_key"))
    own = documents.select("doc_id", source_key("source").alias("source_key"), "text").join(wanted, "source_key", "left_semi")
    tagged = own.select(F.struct("doc_id", "source_key", F.xxhash64("text").alias("h")).alias("row"), "text")
    counted = token_ids(tagged, "row", "text", directory, vocabulary)
    return stored(counted.select("row", F.size("ids").alias("n_tokens")).distinct().select("row.*", "n_tokens"))


def budgets(sizes: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per target: source, source_key, weight, max_repeats, own_tokens, wanted_tokens.

    wanted_tokens is the source's share of the tokens of all documents of the targets' sources,
    each once. One row per target: mix_targets is a table of fixed size.
    """
    own = sizes.groupBy("source_key").agg(F.sum("n_tokens").alias("own_tokens"))
    table = targets(mix_targets).join(own, "source_key", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
    totals = F.struct(F.sum("own_tokens").alias("t"), F.sum("weight").alias("w"))
    gathered = table.groupBy().agg(totals.alias("total"), F.collect_list(F.struct(*table.columns)).alias("rows"))
    flat = gathered.select("total", F.explode("rows").alias("r")).select("r.*", "total")
    return flat.withColumn("wanted_tokens", F.col("total.t") * F.col("weight") / F.col("total.w")).drop("total")


def window(rate: float) -> tuple[int, np.ndarray]:
    """(low, F): P(Poisson(rate) <= low + i) = F[i]; it is 0 below and 1 beyond, in floats.

    About 2 * TAIL * sqrt(rate) values, worked out in logs, so that no rate is too large.
    """
    reach = TAIL * math.sqrt(rate) + 40
    low, high = max(0, int(rate - reach)), int(rate + reach) + 1
    k = np.arange(low + 1, high + 1, dtype=np.float64)
    log_p = low * math.log(rate) - rate - math.lgamma(low + 1) + np.r_[0.0, np.cumsum(math.log(rate) - np.log(k))]
    return low, np.minimum(1.0, np.cumsum(np.exp(log_p)))


def cut_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap): the sum of P(variate > k) for k below the cap."""
    low, upto = window(rate)
    return min(low, cap) + float((1 - upto[: max(0, cap - low)]).sum())


def solve_rate(mean: float, cap: int) -> float:
    """The Poisson rate whose mean after the cut at `cap` is `mean` (above 0, below `cap`)."""
    low, high = 0.0, max(1.0, mean)
    while cut_mean(high, cap) < mean:  # ends: the mean after the cut reaches the cap, in floats
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cut_mean(middle, cap) < mean else (low, middle)
    return high


def distribution(mean: float, cap: int) -> tuple[int, list[float]]:
    """(low, steps) of the cut distribution: a uniform value's count is `low` and how many of the
    steps it reaches."""
    if cap <= 0 or mean <= 0:
        return 0, []
    if mean >= cap:
        return cap, []
    low, upto = window(solve_rate(mean, cap))
    low = min(low, cap)
    return low, upto[: cap - low].tolist()


def repetition(own_tokens: int, wanted_tokens: float) -> float:
    """How often a source's records are wanted; without any token as often as the cap lets them."""
    if own_tokens:
        return wanted_tokens / own_tokens
    return math.inf if wanted_tokens else 0.0


def plan(table: DataFrame) -> DataFrame:
    """source_key, low, steps: the cut Poisson distribution of each target of budgets()."""
    rows = [(r.source_key, *distribution(repetition(r.own_tokens, r.wanted_tokens), r.max_repeats)) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, "source_key string, low int, steps array<double>")


def uniform(key: Column, seed: int) -> Column:
    """A value in [0, 1) from a hash of the record."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def draws(rows: DataFrame, steps: DataFrame, seed: int = SEED) -> DataFrame:
    """`rows` (doc_id, source_key, h, ...) of the targets with n_copies: each record's variate."""
    u = uniform(F.struct(*_RECORD), seed)
    count = F.col("low") + F.size(F.filter("steps", lambda s: u >= s))
    return rows.join(F.broadcast(steps), "source_key").withColumn("n_copies", count).drop("low", "steps")


def exploded(drawn: DataFrame) -> DataFrame:
    """A row per copy, numbered from 1 as `copy`; a record that isn't used has one row with null."""
    return drawn.withColumn("copy", F.explode_outer(F.when(F.col("n_copies") > 0, F.sequence(F.lit(1), F.col("n_copies")))))


def mixed(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source_key, copy, text: the mixed corpus, spread at random over partitions.

    The records themselves pass the one exchange; rows delivered twice draw the same number and fall
    together behind it, so they need none of their own.
    """
    steps = plan(budgets(sized(documents, mix_targets, directory, vocabulary), mix_targets))
    records = documents.select("doc_id", source_key("source").alias("source_key"), "text", F.xxhash64("text").alias("h"))
    copies = exploded(draws(records, steps, seed)).where("copy is not null")
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed), *_RECORD, "copy")).repartition("place")
    once = placed.dropDuplicates(["place", *_RECORD, "copy"])
    return once.sortWithinPartitions("place").select("doc_id", "source_key", "copy", "text")


def shares(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target: the share wanted and reached in the mixed corpus, its tokens and copies, the
    records' number, the least and most copies of one, and reachable.

    Unreachable is a source whose every record was used max_repeats times and whose tokens are fewer
    than wanted, also one without records.
    """
    sizes = sized(documents, mix_targets, directory, vocabulary)
    table = budgets(sizes, mix_targets)
    first = F.coalesce("copy", F.lit(1)) == 1
    used = (
        exploded(draws(sizes, plan(table), seed))
        .groupBy("source_key")
        .agg(
            F.sum(F.when(F.col("copy").isNotNull(), F.col("n_tokens")).otherwise(0)).alias("tokens"),
            F.count("copy").alias("n_copies"),
            F.sum(first.cast("long")).alias("n_records"),
            F.min("n_copies").alias("least_copies"),
            F.max("n_copies").alias("most_copies"),
        )
    )
    both = table.join(F.broadcast(used), "source_key", "left").fillna(0, ["tokens", "n_copies", "n_records"])
    at_cap = F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True))
    both = both.withColumn("reachable", ~(at_cap & (F.col("tokens") < F.col("wanted_tokens"))))
    cols = ["source", "weight", "max_repeats", "own_tokens", "reachable", "tokens", "n_copies", "n_records", "least_copies", "most_copies"]
    gathered = both.groupBy().agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"), F.collect_list(F.struct(*cols)).alias("rows"))
    flat = gathered.select("t", "w", F.explode("rows").alias("r")).select("r.*", "t", "w")
    reached = F.when(F.col("t") > 0, F.col("tokens") / F.col("t")).otherwise(F.lit(0.0))
    return flat.select(*cols, (F.col("weight") / F.col("w")).alias("share_wanted"), reached.alias("share_reached"))


def unreachable(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """The targets' sources that fall short of their share in the replication, every record at its cap."""
    return shares(documents, mix_targets).where(~F.col("reachable")).select("source")
