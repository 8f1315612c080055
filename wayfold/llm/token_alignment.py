"""Cross-tokenizer alignment: the tokens that two tokenizers make of a text, grouped where both end, by a transducer over what one side is ahead of the other."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import byte_symbols
from .common import cut, flushed, rekeyed, scratch, table

#: Transitions that a worker remembers at most.
REMEMBERED = 500_000
#: Parts of texts whose alignment a worker remembers at most.
KNOWN = 400_000
#: Spaces that part a text: after what isn't a space, before what isn't white space. The space belongs to what follows.
PARTS = re.compile(r"(?<=[^ ]) (?=\S)")
#: Id pairs whose counts are broadcast at most, at some 60 bytes each; more are joined by exchange.
BROADCAST_PAIRS = 1_000_000


class Transducer:
    """Reads the tokens of two sides, of the same bytes in all. Its state is which side is ahead and the bytes by which it is; the other side is read next.

    State 0 has no bytes left over: reaching it closes a group. The transition by a state and the next token is worked out from the
    bytes once and remembered; with more than `most` of them it begins anew.
    """

    def __init__(self, a: list[bytes], b: list[bytes], most: int = REMEMBERED):
        self.sides, self.most = (a, b), most
        self._fresh()

    def _fresh(self) -> None:
        self.numbers: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        self.names: list[tuple[bool, bytes]] = [(False, b"")]
        self.a_ahead = [False]
        self.rows = [_Row(self, 0)]
        self.count = 0

    def made(self, state: int, token: int) -> int:
        """The state that a token leads to."""
        a_ahead, rest = self.names[state]
        text = self.sides[a_ahead][token]  # of the other side
        if text.startswith(rest):
            after = (not a_ahead, text[len(rest) :])
        elif rest.startswith(text):
            after = (a_ahead, rest[len(text) :])
        else:
            raise ValueError("the two sides are of different bytes")
        if not after[1]:
            after = (False, b"")
        found = self.numbers.get(after)
        if found is None:
            found = self.numbers[after] = len(self.names)
            self.names.append(after)
            self.a_ahead.append(after[0])
            self.rows.append(_Row(self, found))
        self.count += 1
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """How many tokens of each side the text has up to the end of each group. No token is without bytes."""
        if self.count > self.most:
            self._fresh()
        rows, a_ahead = self.rows, self.a_ahead
        closed = rows[0]
        i = j = 0
        n = len(a)
        ends_a, ends_b = [], []
        while i < n:
            state = closed[a[i]]
            i += 1
            while state:
                if a_ahead[state]:
                    state = rows[state][b[j]]
                    j += 1
                else:
                    state = rows[state][a[i]]
                    i += 1
            ends_a.append(i)
            ends_b.append(j)
        return ends_a, ends_b


class _Row(dict):
    """The transitions from a state, by token; worked out when first asked for."""

    __slots__ = ("owner", "state")

    def __init__(self, owner: Transducer, state: int):
        super().__init__()
        self.owner, self.state = owner, state

    def __missing__(self, token: int) -> int:
        found = self[token] = self.owner.made(self.state, token)
        return found


class Known:
    """What make gives for parts of texts, those of a text that are new at once. Those of two generations are remembered, `most` in all; long ones are not."""

    def __init__(self, make: Callable[[list[str]], Iterable], most: int):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def all(self, parts: list[str]) -> dict[str, tuple | bool]:
        found: dict[str, tuple | bool] = dict.fromkeys(parts)
        young, old, new = self.young, self.old, []
        for p in found:
            if p in young:
                found[p] = young[p]
            elif p in old:
                found[p] = young[p] = old[p]
            else:
                new.append(p)
        if new:
            for p, r in zip(new, self.make(new), strict=True):
                found[p] = r
                if len(p) < 100:
                    young[p] = r
        if len(young) > self.most // 2:
            self.old, self.young = young if len(young) < self.most else {}, {}
        return found


class Pair:
    """A byte-level tokenizers file (a) and a sentencepiece model (b), and the bytes of their tokens."""

    def __init__(self, spec: str, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = SentencePieceProcessor(model_proto=model)
        byte = {s: k for k, s in enumerate(byte_symbols())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.parted = self._parted(json.loads(spec))
        self.known = Known(self._made, KNOWN)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        # what a token is written as: followed by another of its side, by the other side, by the next group
        self.written = [f"{i}{s}".encode() for i in range(max(len(pieces), len(self.a_bytes))) for s in ",|;"]

    def _parted(self, spec: dict) -> bool:
        """Whether both sides' tokens end before each of the spaces that PARTS finds, whatever is around: a splits by the byte-level pattern, where such a space begins a part; b has no piece that goes from another character on to a space."""
        split = spec["pre_tokenizer"]
        by_pattern = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        return bool(by_pattern) and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Both sides' ids of a text with a space before it, or none where a side's tokens don't give it back."""
        spaced = " " + text
        a, b = self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        data = spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data:
            return a, b
        return [], []

    def _made(self, parts: list[str]) -> Iterator[tuple | bool]:
        """(tokens of a, of b, groups, the groups as written, links as 64-bit numbers) of each part of a text, which are aligned as one text; False for a part that a side doesn't give back."""
        a, b = self.tokens(" ".join(parts))
        if not a:
            yield from (False,) if len(parts) == 1 else (x for p in parts for x in self._made([p]))
            return
        ends_a, ends_b = (np.array(x) for x in self.transducer.groups(a, b))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        links = a[ends_a - 1] << 32 | b[ends_b - 1]
        # a's token stands behind b's of the groups before, and b's behind a's of its own group too
        order = np.empty(len(a) + len(b), np.int64)
        for ids, ends, ahead, stop in ((a, ends_a, np.concatenate([[0], ends_b[:-1]]), 1), (b, ends_b, ends_a, 2)):
            code = ids * 3
            code[ends - 1] += stop
            order[np.arange(len(ids)) + np.repeat(ahead, np.diff(ends, prepend=0))] = code
        written = list(map(self.written.__getitem__, order.tolist()))
        upto = np.cumsum(self.a_size[a])[ends_a - 1]
        at = np.searchsorted(upto, np.cumsum([len(p.encode()) + 1 for p in parts])) + 1
        i = j = g = 0
        for end, x, y in zip(at.tolist(), ends_a[at - 1].tolist(), ends_b[at - 1].tolist(), strict=True):
            yield x - i, y - j, end - g, b"".join(written[i + j : x + y])[:-1], links[g:end].tobytes()
            i, j, g = x, y, end

    def aligned(self, text: str) -> tuple[int, int, int, bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of a, of b, groups, the groups as written, and what links there are: a's id, b's id, how often); zeros of an empty text and of one that a side doesn't give back."""
        parts = (PARTS.split(text) if self.parted else [text]) if text else []
        found = self.known.all(parts)
        rows = list(map(found.__getitem__, parts))
        if not rows or False in found.values():
            none = np.zeros(0, np.int32)
            return 0, 0, 0, b"", none, none, none
        n_a, n_b, n_groups, written, links = zip(*rows, strict=True)
        pairs, n = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        return sum(n_a), sum(n_b), sum(n_groups), b";".join(written), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


_LOADED: dict[str, Pair] = {}


def _loaded(name: str, spec: str, model: bytes) -> Pair:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Pair(spec, model)
    return _LOADED[name]


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, link_a, link_b, link_n) for each row of docs.

    byte_level is the path of a tokenizers file of byte-level BPE (a), pieces that of a sentencepiece model that adds a space (b); both are read on the driver,
    and workers get their bytes. Neither sees special tokens in a text. A group is closed where a token of each side ends at the same byte; groups has them
    as `a1,a2|b1;a3|b2,b3`, ids in order. Tokens that end a group are linked; the three arrays have a text's different links and how often it has each.

    Null and empty texts, and those that a side doesn't give back byte by byte (with a space before them), have no tokens: zeros, an empty
    string and empty arrays. Whole texts are read; repeated rows are aligned each; an empty table gives no rows; other columns are not read.
    Both sides' tokens end before most single spaces (PARTS), so the transducer goes from one such space to the next, and workers remember what it gave for
    words. A worker holds the vocabularies, up to REMEMBERED transitions and KNOWN parts, and one text's groups; nothing is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    name, shared = f"{byte_level} {pieces}", sc.broadcast((Path(byte_level).read_text(), Path(pieces).read_bytes()))
    zero, ints = F.lit(0).cast("long"), F.array().cast("array<int>")
    schema = docs.select(F.col(id_col).alias("id"), zero.alias("n_a"), zero.alias("n_b"), zero.alias("n_groups"), F.lit("").alias("groups"), *(ints.alias(f"link_{c}") for c in "abn")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(name, *shared.value)
        rows = ((i.as_py(), *pair.aligned(t.as_py() or "")) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
        yield from flushed(rows, arrow, lambda r: len(r[4]) + 12 * len(r[5]))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _key(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) for rows of aligned(): how many links of all rows are of each pair of ids (a's in the upper, b's in the lower 32 bits), and whether that is the most that b's id has with any (ties: each of them). Counts are summed in each task before they are exchanged."""
    each = links.select(F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("l")).select(_key(F.col("l.link_a"), F.col("l.link_b")).alias("pair"), F.col("l.link_n").cast("long").alias("n"))
    counts = cut(each.groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(links: DataFrame, most_broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """Rows of a written table with link_a, link_b and link_n, and in their place n_links, n_best (links of a pair that no other of b's id is more frequent than, in all rows) and count_sum (the sum of their pairs' counts). Columns row and pair must not be there.

    The counts are broadcast where they are at most most_broadcast, as counted; else they are joined by exchange, where adaptive execution splits a pair that is in most rows.
    """
    keep = [c for c in links.columns if c not in ("link_a", "link_b", "link_n")]
    counts = cut(link_counts(links)).select(rekeyed(F.col("pair")).alias("of"), F.col("n").alias("all"), "best")
    if counts.count() <= most_broadcast:
        counts = F.broadcast(counts)
    each = links.withColumn("row", F.monotonically_increasing_id()).select("row", *keep, F.explode_outer(F.arrays_zip("link_a", "link_b", "link_n")).alias("l"))
    each = each.select("row", *keep, F.col("l.link_n").cast("long").alias("n"), _key(F.col("l.link_a"), F.col("l.link_b")).alias("pair"))
    joined = each.join(counts, F.col("pair") == F.col("of"), "left")
    sums = {"n_links": F.col("n"), "n_best": F.when(F.col("best"), F.col("n")), "count_sum": F.col("n") * F.col("all")}
    return joined.groupBy("row", *keep).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items())).drop("row")


def op13_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    import public_tokenizers

    byte_level, pieces = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    out = aligned(table(spark, sf_dir, "documents"), byte_level, pieces)
    at = scratch(spark, "alignment")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "link_a", "link_b", "link_n").write.parquet(f"{at}/links")
    return scored(spark.read.parquet(f"{at}/links"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
