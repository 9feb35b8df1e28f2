"""Problem 9: statistics of each text, and prose told from the rest.

Besides counts and shares there are repetition statistics: duplicate lines and paragraphs and the
characters covered by the most frequent word pair and by the most frequent run of four words. A text
that consists mostly of repeats isn't prose, however many distinct words it has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.prose import largest, word_weights
from tarn.plans.session import spread

MIN_PROSE = 0.62  # mean word weight of running text
MIN_PROSE_UNENDED = 0.85  # the same where no line ends a sentence
MIN_PROSE_CHARS = 0.28  # mean weight by characters, symbols and codes counting 0
MAX_LEVEL = 8.0  # occurrences per distinct word, in texts of up to MAX_LEVEL * MIN_TYPES words; in longer ones it may grow as the root of their length
MIN_TYPES = 40
MAX_REPEATED = 0.5  # share of words in repeats: lines or paragraphs that stood before, or long runs
MAX_TOP_RUN = 0.5  # share of characters in the most frequent pair or run of four words
LINE_WORDS = 4  # words of a line or paragraph whose repeats count; shorter ones recur in wrapped text
RUN_WORDS = 20  # of a long run, more than a sentence has as a rule
MAX_GARBLED = 0.015  # share of words with letters decoded wrongly
MIN_CHARS = 40  # shorter texts are not judged
_FIELDS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, "
    "ended_lines double, common_words double, duplicate_lines double, duplicate_paragraphs double, top_pair_chars double, "
    "top_four_chars double, repeated double, level double, prose double, prose_chars double, garbled double, is_prose boolean"
)


def _share_repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _top_run(words: list[str], n: int, chars: int) -> float:
    """Share of the text's characters in the most frequent run of n words (the longest of several),
    where it occurs twice."""
    if len(words) < 2 * n or not chars:
        return 0.0
    counts = Counter(zip(*(words[i:] for i in range(n)), strict=False))
    times = max(counts.values())
    if times == 1:
        return 0.0
    longest = max(sum(map(len, run)) for run, seen in counts.items() if seen == times)
    return min(1.0, times * longest / chars)


def _copied(parts: list[str]) -> float:
    """Share of the words that stand in a part of LINE_WORDS words or more that stood before."""
    seen: set[str] = set()
    copied = total = 0
    for part in parts:
        n = len(part.split())
        total += n
        if n >= LINE_WORDS:
            if part in seen:
                copied += n
            seen.add(part)
    return copied / total if total else 0.0


def _rerun(words: list[str]) -> float:
    """Share of the words in runs of RUN_WORDS words that stood before, wherever lines break."""
    n = len(words)
    short = max(0, n - 3)
    # most starts of fours repeat where most words do, so other texts needn't be looked at in long runs
    if n <= RUN_WORDS or len(set(zip(*(words[i:] for i in range(4)), strict=False))) > 0.7 * short:
        return 0.0
    seen: set[int] = set()
    covered = end = 0
    for i in range(n - RUN_WORDS + 1):
        run = hash(tuple(words[i : i + RUN_WORDS]))
        if run in seen:
            covered += i + RUN_WORDS - max(end, i)
            end = i + RUN_WORDS
        seen.add(run)
    return covered / n


class Measure:
    """Statistics of one text."""

    def __init__(self, common: set[str], weights: dict[str, float]) -> None:
        import regex

        self.common, self.weights = common, weights
        self.word = regex.compile(r"[\p{L}\p{N}]+")
        self.inner = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
        self.letters = regex.compile(r"\p{L}+")
        self.symbol = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
        self.digit = regex.compile(r"\p{N}")
        self.ended = regex.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
        self.sentence = regex.compile(r"\p{L}\p{L}[.!?…][\"'”’»)\]]*(?:\s|$)")
        # two-byte characters read one byte at a time
        self.wrong = regex.compile("[Â-ô][\u0080-¿]|[ÃÂÐÑ][\u0080-¿Œ-Ÿ‘-›]")

    def __call__(self, text: str) -> tuple:
        n_chars = len(text)
        chunks, low = text.split(), text.lower()
        dense = sum(map(len, chunks))
        tokens = self.word.findall(low)
        words = self.inner.findall(low)
        lines = [" ".join(x.split()) for x in text.split("\n")]
        lines = [x for x in lines if x]
        paragraphs = [" ".join(x.split()) for x in text.split("\n\n")]
        paragraphs = [x for x in paragraphs if x]
        weigh = [self.weights.get(w, 0.0) for w in tokens]
        n = len(tokens)
        prose = sum(weigh) / n if n else 0.0
        prose_chars = sum(x * len(w) for x, w in zip(weigh, tokens, strict=True)) / dense if dense else 0.0
        level = n / len(set(tokens)) if n else 0.0
        ended = sum(bool(self.ended.search(x)) for x in lines) / len(lines) if lines else 0.0
        garbled = sum(bool(self.wrong.search(x)) for x in chunks) / len(chunks) if self.wrong.search(text) else 0.0
        pair, four = _top_run(words, 2, dense), _top_run(words, 4, dense)
        repeated = max(_copied(lines), _copied(paragraphs), _rerun(words))
        is_prose = (
            prose >= MIN_PROSE
            and prose_chars >= MIN_PROSE_CHARS
            and (prose >= MIN_PROSE_UNENDED or bool(self.sentence.search(text)))
            and level <= MAX_LEVEL * max(1.0, n / (MAX_LEVEL * MIN_TYPES)) ** 0.5
            and repeated <= MAX_REPEATED
            and max(pair, four) <= MAX_TOP_RUN
            and garbled < MAX_GARBLED
        )
        return (
            n_chars,
            len(words),
            sum(map(len, words)) / len(words) if words else 0.0,
            len(self.symbol.findall(text)) / dense if dense else 0.0,
            len(self.digit.findall(text)) / dense if dense else 0.0,
            len(lines),
            ended,
            sum(w in self.common for w in words) / len(words) if words else 0.0,
            _share_repeated(lines),
            _share_repeated(paragraphs),
            pair,
            four,
            repeated,
            level,
            prose,
            prose_chars,
            garbled,
            is_prose,
        )


def statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key and the statistics of each row; a null text counts as empty, an empty one isn't prose.

    common_words is a fixed list; the weights are bounded (see prose). Both go to the tasks.
    """
    common = {r.word.lower() for r in common_words.select("word").distinct().collect() if r.word}
    weights = largest(word_weights(documents, text, label))
    kind = documents.select(key).schema[0].dataType.simpleString()
    names = ["key", *(f.split()[0] for f in _FIELDS.split(", "))]
    types = [pa.float64() if f.endswith("double") else pa.bool_() if f.endswith("boolean") else pa.int64() for f in _FIELDS.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Measure(common, weights)
        for batch in batches:
            rows = [one(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return spread(documents.select(documents[key].alias("key"), documents[text].alias("text"))).mapInArrow(measure, f"key {kind}, {_FIELDS}").withColumnRenamed("key", key)


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of the texts of MIN_CHARS characters or more that are no running text."""
    return statistics(documents, common_words).where((F.col("n_chars") >= MIN_CHARS) & ~F.col("is_prose")).select("doc_id").distinct()
