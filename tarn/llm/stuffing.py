"""Problem 4: keyword-stuffed and link-list pages.

Each text's words are ranked by frequency in a SQL window and a line is fitted to log frequency over
log rank. The line's slope, the residual around it, the repeats per word and the divergence from the
running words of the text's own language are then compared with prose of the same language at the
same length: what prose has is itself fitted, as a function of length, on texts that aren't flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.labels import languages_of
from tarn.llm.prose import distinct_texts, weights_of, words
from tarn.plans.session import stored

CURVE = ("level", "slope", "residual")
FLAGGED = 1.0  # sum of the departures, each in natural logs: a factor e from prose in all
ROUNDS = 3  # of fitting on what isn't flagged; next to nothing changes after the second
MIN_TEXTS = 30  # a language with fewer is judged by all languages' prose
NO_WORD = 0.02  # mean weight that a text without a known word counts with
_USUAL = "lang string, at double, " + ", ".join(f"{f}_mean double, {f}_per double" for f in CURVE)


def curves(docs: DataFrame, text: str = "content", label: str = "lang") -> DataFrame:
    """version, n_words, n_types, slope and residual of the rank-frequency line, lang and prose (mean
    word weight in the language where that is largest): one row per distinct text that has words.

    One exchange, by version, of each distinct text: explode, count and window stay behind it. The
    weights (a bounded table) are broadcast.
    """
    texts = distinct_texts(docs, text, label)
    spoken = texts.select("version", "lang", "site", F.explode(words("text")).alias("word"))
    counts = spoken.groupBy("version", "lang", "site", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("n"), "word"))
    x, y = F.log("rank"), F.log("n")
    unexplained = F.greatest(F.regr_syy(y, x) - F.coalesce(F.regr_sxy(y, x) * F.regr_slope(y, x), F.lit(0.0)), F.lit(0.0))
    fitted = (
        counts.withColumn("rank", rank)
        .groupBy("version", "lang", "site")
        .agg(
            F.sum("n").alias("n_words"),
            F.count("*").alias("n_types"),
            F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
            F.sqrt(unexplained / F.count("*")).alias("residual"),
            F.collect_list(F.struct("word", "n")).alias("counts"),
        )
    )
    own = stored(fitted)
    met = F.transform("counts", lambda c: F.struct(c["word"].alias("word"), F.lit(1).alias("docs"), c["n"].alias("n")))
    weights = weights_of(own.select("lang", "site", "n_words", met.alias("counts")), languages_of(docs, label))
    langs = sorted(weights)
    table: dict[str, list[float]] = {}
    for j, lang in enumerate(langs):
        for word, weight in weights[lang].items():
            table.setdefault(word, [0.0] * len(langs))[j] = weight
    model = docs.sparkSession.createDataFrame(list(table.items()), "word string, weights array<double>")
    known = own.select("version", F.explode("counts").alias("c")).select("version", "c.*").join(F.broadcast(model), "word")
    total = [F.sum(F.col("n") * F.col("weights")[j]).alias(f"t{j}") for j in range(len(langs))] or [F.lit(0.0).alias("t")]
    matched = known.groupBy("version").agg(*total)
    best = F.array_max(F.array(*[F.struct(F.col(f"t{j}").alias("total"), F.lit(lang).alias("lang")) for j, lang in enumerate(langs)])) if langs else F.struct(F.lit(0.0).alias("total"), F.lit("").alias("lang"))
    scored = matched.select("version", best.alias("best"))
    facts = own.select("version", "n_words", "n_types", "slope", "residual").join(scored, "version", "left")
    return facts.select(
        "version", "n_words", "n_types", (F.col("n_words") / F.col("n_types")).alias("level"), "slope", "residual",
        F.col("best.lang").alias("lang"), F.coalesce(F.col("best.total") / F.col("n_words"), F.lit(0.0)).alias("prose"),
    )


def _usual(kept: DataFrame) -> list:
    """Per language, and with a null lang for all together, what prose has: for each fact of the
    curve a line over log length. (Its divergence is 0 by the definition of the weights.)"""
    x = F.col("length")
    numbers = [F.count("*").alias("texts"), F.avg(x).alias("at")]
    for f in CURVE:
        numbers += [F.avg(f).alias(f"{f}_mean"), F.coalesce(F.regr_slope(F.col(f), x), F.lit(0.0)).alias(f"{f}_per")]
    found = kept.cube("lang").agg(*numbers, F.grouping("lang").alias("overall"))
    held = (F.col("overall") == 1) | (F.col("lang").isNotNull() & (F.col("texts") >= MIN_TEXTS))
    names = [f.split()[0] for f in _USUAL.split(", ")]
    return found.where(held & F.col("at").isNotNull()).select(F.when(F.col("overall") == 0, F.col("lang")).alias("lang"), *names[1:]).collect()


def _departures(facts: DataFrame, usual: list, curve: tuple[str, ...] = CURVE) -> DataFrame:
    """`facts` with departure: its divergence, and how far its level is above, its slope and residual
    from what prose of its language and length has; of these three those in `curve`."""
    overall = next((u for u in usual if u["lang"] is None), None)
    if overall is None:
        return facts.withColumn("departure", F.lit(0.0))
    own = facts.sparkSession.createDataFrame([u for u in usual if u["lang"] is not None], _USUAL).select("lang", F.struct(*[f.split()[0] for f in _USUAL.split(", ")][1:]).alias("usual"))
    joined = facts.join(F.broadcast(own), "lang", "left")

    def of(name: str) -> Column:
        return F.coalesce(F.col(f"usual.{name}"), F.lit(overall[name]))

    total = F.col("divergence")
    for f in curve:
        off = F.col(f) - of(f"{f}_mean") - of(f"{f}_per") * (F.col("length") - of("at"))
        total = total + (F.greatest(off, F.lit(0.0)) if f == "level" else F.abs(off))
    return joined.select(*facts.columns, total.alias("departure"))


def judged_texts(docs: DataFrame, text: str = "content", label: str = "lang") -> DataFrame:
    """curves() with departure and stuffed.

    What is usual and the flags are found in turns: the one from texts that aren't flagged, the
    others from it. Each round is one aggregate over a narrow table, of which a row per language
    reaches the driver.
    """
    own = curves(docs, text, label)
    facts = stored(
        own.select(
            "version", "lang", F.log("n_words").alias("length"), (-F.log(F.greatest("prose", F.lit(NO_WORD)))).alias("divergence"),
            F.log("level").alias("level"), "slope", "residual", F.col("n_words"), F.col("n_types"), F.col("prose"),
        )
    )
    judged = _departures(facts, _usual(facts), ())  # at first by the divergence alone
    for _ in range(ROUNDS):
        judged = _departures(facts, _usual(judged.where(F.col("departure") <= FLAGGED)))
    exact = F.col("n_words") / F.col("n_types")
    return judged.select("version", "n_words", "n_types", exact.alias("level"), "slope", "residual", F.col("lang").alias("spoken"), "prose", "departure", (F.col("departure") > FLAGGED).alias("stuffed"))


def judged(docs: DataFrame, key: str = "seq", text: str = "content", label: str = "lang") -> DataFrame:
    """key and the columns of judged_texts() of its text, each pair once: n_words, n_types, level,
    slope, residual, spoken (language), prose, departure, stuffed.

    Pages without words (null, empty or blank text) give no row, other columns of `docs` are left out.
    """
    keys = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("version")).distinct()
    return keys.join(judged_texts(docs, text, label), "version").drop("version").withColumnRenamed("key", key)


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """seq of the pages whose content is mainly stuffing, links or tags."""
    return judged(docs).where("stuffed").select("seq").distinct()
