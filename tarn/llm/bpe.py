"""Problem 7: token ids of a whole corpus by a public byte-level BPE vocabulary.

Each task splits its texts into words by the vocabulary's pattern. Words it hasn't met go to DuckDB
as rows of (word, position, token); a recursive query joins neighbours with the merge table and
contracts, in every word, the pair of lowest rank until no pair is left. An ordered aggregate gives
the ids of a word, and a text's ids are those of its words in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.plans.session import spread

#: Fixed value: the pattern that splits text before merging, as published with the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED_WORDS = 1 << 18  # words whose ids a task remembers; beyond that it forgets and asks again
WORD_BATCH = 1 << 14  # words a recursive query takes at a time
LONG_WORD = 1 << 14  # bytes; a longer word fills a query by itself

# The state is keyed, so that a step replaces the tokens it contracts and no earlier step is kept; a
# token that went into its left neighbour is -1. Words that nothing changed in aren't looked at again.
_STEP = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
  SELECT word, pos, token FROM start
  UNION
  SELECT word, pos, CASE WHEN take THEN best ELSE -1 END
  FROM (
    SELECT word, pos, best, take, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
    FROM (
      SELECT word, pos, best, hit, hit AND (row_number() OVER (PARTITION BY word, hit, island ORDER BY pos)) % 2 = 1 AS take
      FROM (
        SELECT word, pos, best, hit,
               row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island
        FROM (
          SELECT word, pos, best, coalesce(merged = best, false) AS hit
          FROM (
            SELECT n.word, n.pos, m.merged, min(m.merged) OVER (PARTITION BY n.word) AS best
            FROM (
              SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next
              FROM recurring.state WHERE token >= 0 AND word IN (SELECT word FROM state)
            ) n
            LEFT JOIN merges m ON m.l = n.token AND m.r = n.next
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE take OR eaten
)
SELECT word, list(token ORDER BY pos) AS ids FROM state WHERE token >= 0 GROUP BY word ORDER BY word
"""
_TEXT = "SELECT text, string_agg(bytes, '' ORDER BY pos) AS bytes FROM asked JOIN tokens USING (id) GROUP BY text ORDER BY text"


@lru_cache(maxsize=4)
def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}


@lru_cache(maxsize=4)
def _merges(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Token of each byte; which two bytes stand side by side in any token; and the merge table:
    l, r, merged (whose id is the pair's rank)."""
    ranks = _ranks(vocabulary)
    beside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        beside[list(token[:-1]), list(token[1:])] = True
    byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
    rows = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    l, r, merged = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
    return byte, beside, pa.table({"l": l, "r": r, "merged": merged})


class WordEncoder:
    """Ids of words by the recursive query; keeps a bounded number of answers."""

    def __init__(self, vocabulary: bytes) -> None:
        import duckdb

        self.byte, self.beside, merges = _merges(vocabulary)
        # in memory alone: a batch's rows are bounded, and a spill would go to the machine's own disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})
        self.db.register("merge_rows", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.known: dict[str, np.ndarray] = {}

    def _ask(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. A word is cut where two bytes meet that no token holds side by side: no
        contraction crosses such a place, so the pieces are words to the query."""
        encoded = [np.frombuffer(w.encode("utf-8", "surrogatepass"), dtype=np.uint8) for w in words]
        sizes = np.array([len(x) for x in encoded], dtype=np.int64)
        flat = np.concatenate(encoded)
        first = np.zeros(len(flat), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        cut = first | np.r_[True, ~self.beside[flat[:-1], flat[1:]]]
        piece = np.cumsum(cut) - 1
        starts = np.flatnonzero(cut)
        start = pa.table({"word": piece.astype(np.int32), "pos": (np.arange(len(flat)) - starts[piece]).astype(np.int32), "token": self.byte[flat]})
        self.db.register("start", start)
        ids = self.db.sql(_STEP).to_arrow_table().column("ids").combine_chunks()
        tokens, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        of_word = np.r_[piece[first], len(starts)]
        return [tokens[ends[a] : ends[b]] for a, b in zip(of_word[:-1], of_word[1:], strict=True)]

    def learn(self, words: set[str]) -> dict[str, np.ndarray]:
        """Ids of the given words."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = sorted(words - self.known.keys(), key=lambda w: (len(w), w))
        answers: dict[str, np.ndarray] = {}
        batch: list[str] = []
        size = 0
        for word in [*new, None]:
            if batch and (word is None or len(batch) >= WORD_BATCH or size + 4 * len(word) > 16 * WORD_BATCH):
                answers |= dict(zip(batch, self._ask(batch), strict=True))
                batch, size = [], 0
            if word is not None:
                batch.append(word)
                size += 4 * len(word)
        self.known |= {w: ids for w, ids in answers.items() if len(w) <= LONG_WORD}
        return answers


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, ids); a null or empty text has no ids."""
    import regex

    split = regex.compile(PATTERN).findall
    encoder = WordEncoder(vocabulary)
    none = np.zeros(0, dtype=np.int32)
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            words = [split(t) if t else [] for t in batch.column(1).to_pylist()]
            fresh = encoder.learn({w for ws in words for w in ws})
            known = encoder.known
            parts = [known[w] if w in known else fresh[w] for ws in words for w in ws]
            sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
            upto = np.r_[0, np.cumsum(sizes)]
            ends = upto[np.r_[0, np.cumsum([len(ws) for ws in words])].astype(np.int64)]
            flat = np.concatenate(parts).astype(np.int32) if parts else none
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])


def read_vocabulary(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> bytes:
    return Path(directory, name).read_bytes()


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids (array<int>) of every row. Special tokens are ordinary text.

    Null and empty texts give an empty list; a null key stays null; rows delivered twice come twice.
    The vocabulary (under 1 MB, of fixed size) is read by the driver and sent to each task.
    """
    content = read_vocabulary(directory, vocabulary)
    kind = documents.select(key).schema[0].dataType.simpleString()
    return (
        spread(documents.select(documents[key].alias("id"), documents[text].alias("text")))
        .mapInArrow(lambda batches: encode_batches(batches, content), f"id {kind}, ids array<int>")
        .withColumnRenamed("id", key)
    )


class Decoder:
    """Texts of id lists by a join with the vocabulary and an ordered aggregate."""

    def __init__(self, vocabulary: bytes) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})
        ranks = _ranks(vocabulary)
        rows = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.hex() for t in ranks]})
        self.db.register("token_rows", rows)
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM token_rows")

    def __call__(self, lists: list[list[int] | None]) -> list[str]:
        """The text of each list; an empty or null one gives ''. Bytes cut within a character are
        replaced; an id that the vocabulary lacks stands for nothing."""
        sizes = [len(x or ()) for x in lists]
        at, pos = np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.arange(0)])
        self.db.register("asked", pa.table({"text": at, "pos": pos, "id": pa.array([i for x in lists for i in x or ()], pa.int32())}))
        found = dict(self.db.sql(_TEXT).fetchall())
        return [bytes.fromhex(found.get(i, "")).decode("utf-8", "replace") for i in range(len(lists))]


def texts_of(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, text of every row of token_ids(): the way back."""
    content = read_vocabulary(directory, vocabulary)
    kind = encoded.select(key).schema[0].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(content)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoder(batch.column(1).to_pylist()), pa.string())], names=["id", "text"])

    rows = spread(encoded.select(encoded[key].alias("id"), encoded[ids].alias("ids")))
    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", key)
