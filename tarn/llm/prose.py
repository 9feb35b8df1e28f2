"""What running text looks like: the words that much of a language's documents share.

The weight of a word in a language is the share of the language's documents that it stands in, over
the mean such share of that language's running words. Running text has a mean weight about 1 in its
own language; lists, labels, links and codes are far below in every one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.hosts import site
from tarn.llm.labels import languages_of, named_language
from tarn.plans.session import cut, stored

WORD = r"[\p{L}\p{N}]+"
LETTERS = r"^\p{L}+$"
MIN_SHARE = 0.02  # of a language's documents; so a language has at most 50 times its mean number of words a document
MAX_SITE = 0.05  # of a language's documents that one site counts for, at most
MIN_WORDS = 20  # documents with fewer words teach nothing
Weights = dict[str, dict[str, float]]  # by language, then word


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def distinct_texts(rows: DataFrame, text: str, label: str, url: str = "url") -> DataFrame:
    """version (hash of the text), text, lang, site: each text once, however often it is delivered.

    lang is the language of its labels (null where none names one) and site that of its urls, the
    least pair where there are several; '' where no site is known or there is no column `url`.
    """
    host = F.coalesce(site(url), F.lit("")) if url in rows.columns else F.lit("")
    known = rows.select(F.xxhash64(text).alias("version"), F.col(text).alias("text"), named_language(label).alias("lang"), host.alias("site")).where("text is not null")
    said = F.min(F.when(F.col("lang").isNotNull(), F.struct("site", "lang"))).alias("said")
    once = known.groupBy("version").agg(F.first("text").alias("text"), said, F.min("site").alias("site"))
    return once.select("version", "text", F.col("said.lang").alias("lang"), F.coalesce("said.site", "site").alias("site"))


def word_weights(texts: DataFrame, text: str, label: str, url: str = "url") -> Weights:
    """Weights learned from all rows whose label names a language.

    A text counts once, and a site's texts count less where it has more than its cap (site_caps), so
    that neither copies nor one site's pages make their words look like running ones. Texts of
    unknown site count as one site's.

    The result is bounded: words in at least MIN_SHARE of a language's documents. Wrong labels are
    a minority in any language and change the shares little.
    """
    langs = languages_of(texts, label)
    own = stored(distinct_texts(texts, text, label, url).where(F.col("lang").isin(langs)).select("lang", "site", words("text").alias("words")))
    met = F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(0).alias("docs"), F.lit(1).alias("n")))
    stood = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("docs"), F.lit(0).alias("n")))
    return weights_of(own.select("lang", "site", F.size("words").alias("n_words"), F.concat(met, stood).alias("counts")), langs)


def weights_of(texts: DataFrame, langs: list[str]) -> Weights:
    """word_weights() from lang, site, n_words and counts (array of word, docs, n) of each text.

    Sites over their cap are few, so their factors are broadcast and the words of a language are
    summed map-side, whatever the number of sites.
    """
    taught = texts.where(F.col("lang").isin(langs) & (F.col("n_words") >= MIN_WORDS))
    sizes = cut(taught.groupBy("lang", "site").agg(F.count("*").alias("texts")))
    caps = site_caps(sizes)
    if not caps:
        return {}
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("lang"))
    factors = sizes.where(F.col("texts") > cap).select("lang", "site", (cap / F.col("texts")).alias("factor"))
    factor = F.coalesce("factor", F.lit(1.0))
    counted = sizes.join(F.broadcast(factors), ["lang", "site"], "left").groupBy("lang").agg(F.sum(F.col("texts") * factor).alias("n"))
    each = taught.join(F.broadcast(factors), ["lang", "site"], "left").select("lang", factor.alias("factor"), F.explode("counts").alias("w"))
    used = each.groupBy("lang", "w.word").agg(F.sum(F.col("w.docs") * F.col("factor")).alias("docs"), F.sum(F.col("w.n") * F.col("factor")).alias("n"))
    return _normalised(cut(used), {r["lang"]: r["n"] for r in counted.collect()})


def largest(weights: Weights) -> dict[str, float]:
    """The largest weight of each word, for texts that may mix languages."""
    out: dict[str, float] = {}
    for own in weights.values():
        for word, weight in own.items():
            out[word] = max(weight, out.get(word, 0.0))
    return out


def site_caps(sizes: DataFrame) -> dict[str, float]:
    """For each language the number of texts that a site counts for at most: MAX_SITE of all that
    count, or twice an even share where sites are few.

    At most 1 / MAX_SITE sites can be above it, so the largest ones and a total say it.
    """
    largest = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("texts")))
    top: dict[str, list[int]] = {}
    for r in sizes.withColumn("at", largest).where(F.col("at") <= round(1 / MAX_SITE)).orderBy("lang", "at").collect():
        top.setdefault(r.lang, []).append(r.texts)
    caps = {}
    for r in sizes.groupBy("lang").agg(F.sum("texts").alias("texts"), F.count("*").alias("sites")).collect():
        most, rest = max(MAX_SITE, 2 / r.sites), r.texts
        caps[r.lang] = float(r.texts)
        for above, texts in enumerate(top[r.lang]):
            if above * most >= 1:
                break
            caps[r.lang] = most * rest / (1 - most * above)  # with so many sites at the cap
            if texts <= caps[r.lang]:
                break
            rest -= texts
    return caps


def _normalised(used: DataFrame, texts: dict[str, float]) -> Weights:
    """Shares of the words (lang, word, docs, n) over the mean share of the language's running words."""
    all_texts = F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col("lang"))
    shares = used.where(F.col("word").rlike(LETTERS)).select("lang", "word", (F.col("docs") / all_texts).alias("share")).where(F.col("share") >= MIN_SHARE).collect()
    known = used.sparkSession.createDataFrame(shares, "lang string, word string, share double")
    sums = used.join(F.broadcast(known), ["lang", "word"], "left").groupBy("lang").agg((F.sum(F.coalesce("share", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("mean")).collect()
    mean = {r["lang"]: r["mean"] for r in sums}
    weights: Weights = {}
    for r in shares:
        if mean.get(r.lang):
            weights.setdefault(r.lang, {})[r.word] = r.share / mean[r.lang]
    return weights
