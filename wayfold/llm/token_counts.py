"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building the pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Remembered, table

#: Words whose counts a worker remembers at most.
REMEMBERED = 400_000
#: The nodes that words and continuations start from.
WORD_ROOT, NEXT_ROOT = 0, 1


class Matcher:
    """A trie of the pieces that begin words and one of those that continue them, over UTF-8 bytes, with failure links.

    A node's failure link names the node to go on from when no transition fits: what is left of its bytes once the longest pieces at
    their front are popped; popped has how many these are. -1: they can't be popped, so the word has no segmentation. Each byte
    moves forward once and links only shorten what is held, so a word takes time linear in its length.
    """

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends = set()
        children: list[list[int]] = [[], []]
        for root, pieces in ((WORD_ROOT, initial), (NEXT_ROOT, following)):
            for piece in pieces:
                at = root
                for b in piece:
                    to = self.step.get(at << 8 | b)
                    if to is None:
                        to = self.step[at << 8 | b] = len(children)
                        children[at].append(b)
                        children.append([])
                    at = to
                if piece:
                    ends.add(at)
        self.fail, self.popped = [-1] * len(children), [0] * len(children)
        level = [WORD_ROOT, NEXT_ROOT]
        while level:
            below = []
            for parent in level:
                for b in children[parent]:
                    node = self.step[parent << 8 | b]
                    below.append(node)
                    if node in ends:
                        self.fail[node], self.popped[node] = NEXT_ROOT, 1
                        continue
                    n, z = self.popped[parent], self.fail[parent]
                    while z >= 0 and z << 8 | b not in self.step:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[node], self.popped[node] = self.step[z << 8 | b], n
            level = below

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match gives for a word; 0 if it finds none at some place."""
        step, fail, popped = self.step.get, self.fail, self.popped
        node = n = 0
        for b in word:
            while (to := step(node << 8 | b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != NEXT_ROOT:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def pieces_of(model: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a sentencepiece model that begin a word (they are marked there) and that continue one; byte, control and unknown pieces are no text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    marked = [t[1:].encode() for t in texts if t[0] == "▁" and len(t) > 1]
    return marked, [t.encode() for t in texts if t[0] != "▁"]


_BUILT: dict[str, Remembered] = {}


def _counter(name: str, vocabulary: tuple[list[bytes], list[bytes]]) -> Remembered:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Remembered(Matcher(*vocabulary).count, REMEMBERED)
    return _BUILT[name]


def token_counts(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for each row of docs.

    Words are parted by ASCII white space. A word counts as its greedy longest-match pieces; one that has no such segmentation
    counts as one unknown token. vocabulary has the pieces that begin words and those that continue them; that and the automaton made of it are
    all that a worker holds, besides the counts of up to REMEMBERED words. Whole texts are counted. Null and empty texts have
    no words; repeated rows are counted each; an empty table gives no rows; other columns are not read.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    schema = docs.select(F.col(id_col).alias("id"), *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_tokens", "n_unknown"))).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counter(name, shared.value)
        for b in batches:
            found = []
            for t in b.column(1):
                counts = list(map(known.__getitem__, (t.as_py() or b"").split()))
                none = counts.count(0)
                found.append((len(counts), sum(counts) + none, none))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), pieces_of(model)).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
