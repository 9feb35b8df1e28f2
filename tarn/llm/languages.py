"""Problem 6: language of each text and of each line in another language.

Rank-order profiles: the most frequent character n-grams of a language, by rank. A text's own
ranking is compared by out-of-place distance: the sum of rank differences, grams that a profile
lacks counting as the profile's length. The languages are those that the delivered labels name.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.labels import languages_of, named_language
from tarn.plans.session import spread

MAX_GRAM = 4
PROFILE = 2000  # grams of a profile
MAX_SAMPLE = 20_000  # labelled rows the profiles are fitted on, at most (in expectation)
MIN_AGREED = 0.5  # share of a label's sampled texts that its first profile finds again, else it names no language
MIN_WORDS = 4  # of a line of running text
MIN_MARGIN = 0.15  # by which a line must be nearer to another language than to its text's
REMEMBERED = 1 << 17  # words and lines a task remembers
CHUNK_GRAMS = 1 << 20  # grams ranked at a time
_JUDGED = "line_no int, lang string, confidence double, running boolean"


def _tie(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


def word_grams(word: str) -> list[str]:
    """1- to 4-grams of a word with its bounds marked."""
    marked = f"_{word}_"
    n = len(marked)
    return [marked[i : i + k] for k in range(1, MAX_GRAM + 1) for i in range(n - k + 1) if marked[i : i + k] != "_"]


class Profiles:
    """Out-of-place distances to fixed profiles; remembers the grams of words and what lines are."""

    def __init__(self, ranks: dict[str, dict[str, int]]) -> None:
        import html

        import regex

        self.unescape = html.unescape
        self.word = regex.compile(r"\p{L}+")
        closing = r"[\"'”’»)\]]*"
        self.end = regex.compile(rf"[\p{{L}}\p{{N}}]{closing}[.!?…。！？]+{closing}(?:\s|$)")
        self.langs = sorted(ranks)
        known = sorted({g for r in ranks.values() for g in r})
        # grams that a profile lacks, and in the last row unknown ones, are out of any rank's reach
        self.table = np.full((len(known) + 1, len(self.langs)), 3 * PROFILE, dtype=np.int16)
        self.base = {g: i for i, g in enumerate(known)}
        for j, lang in enumerate(self.langs):
            for g, rank in ranks[lang].items():
                self.table[self.base[g], j] = rank
        self.base_ties = np.array([_tie(g) for g in known], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.ties = dict(self.base), self.base_ties
        self.words: dict[str, np.ndarray] = {}
        self.lines: dict[str, tuple | None] = {}

    def _word(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            own = []
            for g in word_grams(word):
                i = self.ids.get(g)
                if i is None:
                    i = self.ids[g] = len(self.ids)
                    if i >= len(self.ties):
                        self.ties = np.concatenate([self.ties, np.zeros(max(1024, i), dtype=np.int64)])
                    self.ties[i] = _tie(g)
                own.append(i)
            got = self.words[word] = np.array(own, dtype=np.int64)
        return got

    def distances(self, texts: list[list[str]]) -> np.ndarray:
        """Distance of each list of words to each language, 0 to 1: a row per list, none of them empty."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        known, learn = self.words, self._word
        grams = [known[w] if w in known else learn(w) for words in texts for w in words]
        words = np.r_[0, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))]
        upto = np.r_[0, np.cumsum(np.fromiter(map(len, grams), dtype=np.int64, count=len(grams)))][words]
        out, first = [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + CHUNK_GRAMS, "right")) - 1)
            out.append(self._ranked(np.concatenate(grams[words[first] : words[last]]), np.diff(upto[first : last + 1])))
            first = last
        return np.concatenate(out)

    def _ranked(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for the gram ids of texts of these sizes, in two sorts: by gram to count, by count
        to rank."""
        bits = len(self.ids).bit_length()
        keys = grams | np.repeat(np.arange(len(sizes)) << bits, sizes)
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[starts, len(keys)])
        text, gram = keys[starts] >> bits, keys[starts] & ((1 << bits) - 1)
        ties, most = self.ties[gram], int(counts.max())
        if len(sizes).bit_length() + most.bit_length() + 32 < 63:  # one number says the order: text, count falling, tie
            order = np.argsort((text << (most.bit_length() + 32)) | ((most - counts) << 32) | ties)
        else:
            order = np.lexsort((ties, -counts, text))
        text, gram = text[order], gram[order]
        first = np.searchsorted(text, np.arange(len(sizes)))
        rank = np.arange(len(text)) - first[text]
        if rank.max() >= PROFILE:
            best = rank < PROFILE
            text, gram, rank = text[best], gram[best], rank[best]
            first = np.searchsorted(text, np.arange(len(sizes)))
        apart = np.abs(self.table[np.minimum(gram, len(self.table) - 1)] - rank.astype(np.int16)[:, None])
        np.minimum(apart, PROFILE, out=apart)
        return np.add.reduceat(apart, first, axis=0, dtype=np.int64) / (PROFILE * np.diff(np.r_[first, len(text)])[:, None])

    def wholes(self, texts: list[str]) -> list[str | None]:
        """The nearest language of each text as a whole; None for one of under MIN_WORDS words."""
        words = [self.word.findall(self.unescape(t).lower()) for t in texts]
        long = [i for i, w in enumerate(words) if len(w) >= MIN_WORDS]
        out: list[str | None] = [None] * len(texts)
        for i, d in zip(long, self.distances([words[i] for i in long]), strict=True):
            out[i] = self.langs[int(d.argmin())]
        if len(self.words) > REMEMBERED:
            self._forget()
        return out

    def _learn(self, lines: set[str]) -> None:
        """What each line is: (characters, running, distances), or None without a word. Running
        lines hold a sentence's end and some words."""
        names, words = [], []
        for line in lines:
            text = " ".join(self.unescape(line).split())
            own = self.word.findall(text.lower())
            self.lines[line] = None
            if own:
                names.append((line, len(text), bool(len(own) >= MIN_WORDS and self.end.search(text))))
                words.append(own)
        for (line, chars, running), d in zip(names, self.distances(words), strict=True):
            self.lines[line] = (chars, running, d)

    def judge(self, texts: list[str]) -> list[list[tuple[int, str | None, float, bool]]]:
        """For each text (line_no, language, confidence, running): line 0 for the text, then its
        running lines in other languages.

        The language of a text is the one with most characters, headings and other lines counting
        like running ones. running says whether it has running lines. Confidence
        is, for a text, the share of its running characters (of all, where none are) in that
        language; for a line, how much nearer it is than the text's language, relative to that. A
        text without a letter has no language and confidence 0.
        """
        if len(self.words) > REMEMBERED or len(self.lines) > REMEMBERED:
            self._forget()
        split = [t.split("\n") for t in texts]
        if self.langs:
            self._learn({line for lines in split for line in lines} - self.lines.keys())
        return [self._judge([(i, got) for i, line in enumerate(lines, 1) if (got := self.lines.get(line))]) for lines in split]

    def _judge(self, lines: list[tuple[int, tuple]]) -> list[tuple[int, str | None, float, bool]]:
        if not lines:
            return [(0, None, 0.0, False)]
        share, rest = np.zeros(len(self.langs)), np.zeros(len(self.langs))
        for _, (chars, running, d) in lines:
            (share if running else rest)[int(d.argmin())] += chars
        main = int((share + rest).argmax())
        counted = share if share.any() else rest
        out: list = [(0, self.langs[main], float(counted[main] / counted.sum()), bool(share.any()))]
        for i, (_, running, d) in lines:
            best = int(d.argmin())
            margin = float((d[main] - d[best]) / d[main]) if running and d[main] else 0.0
            if best != main and margin >= MIN_MARGIN:
                out.append((i, self.langs[best], margin, True))
        return out


def _count_grams(batches: Iterator[pa.RecordBatch], ranks: dict[str, dict[str, int]] | None) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), the empty gram counting texts; with ranks given, only texts
    that they give their label."""
    import regex

    word = regex.compile(r"\p{L}+")
    judge = Profiles(ranks) if ranks else None
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, text, found in zip(langs, texts, judge.wholes(texts) if judge else langs, strict=True):
            if found == lang:
                counts[lang].update(word.findall(text.lower()))
                counts[lang][""] += 1
    for lang, words in counts.items():
        grams: Counter = Counter()
        for w, n in words.items():
            if not w:
                grams[w] = n
                continue
            for g in word_grams(w):
                grams[g] += n
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, text: str = "content", label: str = "lang", max_rows: int = MAX_SAMPLE) -> dict[str, dict[str, int]]:
    """Profiles from labelled rows, at most `max_rows` in expectation, chosen by a hash of the text.

    A second pass leaves out texts that the first profiles don't give their label, and labels most
    of whose texts are such: they name no language. At most PROFILE rows a language reach the
    driver, and there are at most 1 / labels.MIN_SHARE languages.
    """
    langs = languages_of(docs, label)
    labelled = docs.select(named_language(label).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(langs) & (F.length("text") > 0))
    n = labelled.count()
    if n > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    ranks: dict[str, dict[str, int]] | None = None
    texts: dict[str, int] = {}
    for _ in range(2):
        counted = spread(labelled).mapInArrow(lambda batches, given=ranks: _count_grams(batches, given), "lang string, gram string, n long")
        total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        tie = F.crc32(F.encode("gram", "UTF-8"))
        order = Window.partitionBy("lang").orderBy(F.col("gram") != "", F.desc("n"), tie)
        top = total.withColumn("rank", F.row_number().over(order) - 2).where(F.col("rank") < PROFILE)
        before, ranks, texts = texts, {}, {}
        for r in top.select("lang", "gram", "rank", "n").collect():
            if r["rank"] < 0:
                texts[r["lang"]] = r["n"]
            else:
                ranks.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
        ranks = {lang: own for lang, own in ranks.items() if texts[lang] >= MIN_AGREED * before.get(lang, 0)}
        if not ranks:
            return {}
    return ranks


def judged_lines(docs: DataFrame, key: str = "seq", text: str = "content", label: str = "lang") -> DataFrame:
    """key, label, line_no, lang, confidence, running: line 0 for every row, and each line of running
    text in another language than most of it.

    running is false in line 0 of a text without running sentences; its language comes from its
    other lines. Null, empty and letterless texts have a null language and confidence 0.
    """
    ranks = fit_profiles(docs, text, label)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(ranks)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                judged = profiles.judge([t or "" for t in batch.column(2).to_pylist()])
                rows = [(i, *found) for i, own in enumerate(judged) for found in own]
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int32()), (2, pa.string()), (3, pa.float64()), (4, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["key", "label", "line_no", "lang", "confidence", "running"])

    rows = docs.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(judge, f"key {kind}, label string, {_JUDGED}").withColumnRenamed("key", key)


def found_languages(docs: DataFrame, stuffed: DataFrame) -> DataFrame:
    """seq, line_no, lang: rows whose label names no language or another one (line 0), and lines in
    another language; texts without running sentences and the rows of `stuffed` (seq) are left out."""
    lines = judged_lines(docs).where("running").join(stuffed.select("seq").distinct(), "seq", "left_anti")
    wrong = ~named_language("label").eqNullSafe(F.col("lang"))
    return lines.where((F.col("line_no") > 0) | wrong).select("seq", "line_no", "lang").distinct()
