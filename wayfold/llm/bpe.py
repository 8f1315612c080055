"""BPE encoding and decoding with a tokenization automaton."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Remembered, table

#: Words whose ids a worker remembers at most.
REMEMBERED = 300_000
#: Transition rows that a worker's table holds at once, a bit for each token.
TABLE = 6000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's own where it prints in Latin-1, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in set(own) else next(free)) for b in range(256)]


class Automaton:
    """The deterministic automaton over tokens that accepts exactly the BPE segmentations of all words.

    It begins with one state that loops on every base symbol. The gadget of a merge (u, v), applied in order of priority: with q the
    state that u leads to, a copy of q without the transition on v becomes what u leads to, and the new token uv leads, from
    wherever u could be read, to where v led from q. A token always leads to one state, so a state is a copy's parent and the token it
    lacks: state k + 1 is made by merge k. Every later token that v was the left part of is lacking too, as v couldn't be read when it was made.

    The table has a row for each state, of bits for the tokens that can be read there. Tokens are numbered so that those a gadget takes
    away have consecutive numbers: each is followed by all that have grown out of it to the right, in the order in which they were made. Rows are
    compiled when a state is first reached; there are 49,152 by 49,152 bits in all.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        leads, self.parent = dict.fromkeys(base, 0), [0] * (len(merges) + 1)
        grown: dict[int, list[tuple[int, int]]] = {}
        for k, (u, v, uv) in enumerate(merges):
            q, r = leads[u], leads[v]
            self.parent[k + 1] = q
            leads[u] = k + 1
            leads[uv] = r
            grown.setdefault(u, []).append((k, uv))
        self.leads = leads
        self.number: dict[int, int] = {}
        end: dict[int, int] = {}
        for root in base:
            walk = [(root, False)]
            while walk:
                t, done = walk.pop()
                if done:
                    end[t] = len(self.number)
                else:
                    self.number[t] = len(self.number)
                    walk += [(t, True), *((uv, False) for _, uv in reversed(grown.get(t, ())))]
        # what state k + 1 lacks more than its parent: the token itself, and a run of numbers
        self.lacks = []
        for k, (_, v, _) in enumerate(merges):
            later = grown.get(v, ())
            first = bisect_left(later, (k, -1))
            self.lacks.append((self.number[v], self.number[later[first][1]] if first < len(later) else end[v], end[v]))
        self.rows: dict[int, bytes] = {}

    def row(self, state: int) -> bytes:
        """The bits of the tokens that can be read in a state."""
        found = self.rows.get(state)
        if found is None:
            can, s = np.ones(len(self.number), bool), state
            while s:
                token, first, end = self.lacks[s - 1]
                can[token] = False
                can[first:end] = False
                s = self.parent[s]
            if len(self.rows) >= TABLE:
                self.rows.clear()
            found = self.rows[state] = np.packbits(can, bitorder="little").tobytes()
        return found


#: The pattern for which text of Latin letters, without other digits than 0-9 and without separator controls, has an equivalent in terms of ranges, which is quicker.
COMMON_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_NOT_QUICK = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


class Tokenizer:
    """A byte-level BPE tokenizer with word ends, as described by a tokenizers file: NFC, white space, lower case, a splitting pattern, bytes, merges."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.labels = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        pattern = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.quick = pattern == COMMON_SPLIT
        self.split = regex.compile(pattern.replace("\\s", "\\p{White_Space}"), regex.V0)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = Remembered(self.word, REMEMBERED)

    @cached_property
    def automaton(self) -> Automaton:
        rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in self.merges]
        made = {r[2] for r in rules}
        return Automaton([i for i in self.vocab.values() if i not in made], rules)

    @cached_property
    def inner(self) -> dict[str, int]:
        return {s: i for s, i in self.vocab.items() if not (self.end and s.endswith(self.end))}

    @cached_property
    def final(self) -> dict[str, int]:
        return {s[: len(s) - len(self.end)]: i for s, i in self.vocab.items() if s.endswith(self.end)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.final), default=1)

    @cached_property
    def spelled(self) -> ahocorasick.Automaton:
        """The automaton over symbols that tells, at each place of a word, which tokens end there: their lengths, ids and numbers."""
        out = ahocorasick.Automaton()
        for s, i in self.inner.items():
            out.add_word(s, (len(s), i, self.automaton.number[i]))
        out.make_automaton()
        return out

    @cached_property
    def symbols(self) -> list[str]:
        return byte_symbols()

    def word(self, word: str) -> bytes:
        """Ids, four bytes each, of a word that the pattern has split off: the path that the automaton accepts.

        The word is walked forward once, through the automaton of spellings. What comes before a place has one path only, so each place has
        one last token, or none: that which ends there and can be read, by the table, in the state of the place where it begins.
        """
        text = "".join(map(self.symbols.__getitem__, word.encode()))
        final = self.final.get
        if (whole := final(text)) is not None:  # one arc from the first state, which lacks nothing
            return np.array([whole], "<u4").tobytes()
        n, number, leads, row = len(text), self.automaton.number, self.automaton.leads, self.automaton.row
        last: list[int | None] = [None] * (n + 1)
        begins, rows = [0] * (n + 1), [None] * (n + 1)
        for before, (size, token, k) in self.spelled.iter(text[:-1]):
            stop = before + 1
            if last[stop] is not None:
                continue
            if at := stop - size:
                if (bits := rows[at]) is None:
                    if last[at] is None:
                        continue
                    bits = rows[at] = row(leads[last[at]])
                if not bits[k >> 3] >> (k & 7) & 1:
                    continue
            last[stop], begins[stop] = token, at
        for at in range(max(1, n - self.longest), n):
            if last[at] is not None and (token := final(text[at:])) is not None:
                bits, k = rows[at] or row(leads[last[at]]), number[token]
                if bits[k >> 3] >> (k & 7) & 1:
                    last[n], begins[n] = token, at
                    break
        out, stop = [], n
        while stop:
            out.append(last[stop])
            stop = begins[stop]
        return np.array(out[::-1], "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text; all white space only parts them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case here is by character, without final forms
        text = text.lower()
        return (self.split if not self.quick or _NOT_QUICK.search(text) else _QUICK).findall(text)

    def encode(self, text: str) -> bytes:
        """The text's ids, four bytes each, lowest first."""
        out = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            out.append(np.array([self.added[part]], "<u4").tobytes() if k % 2 else b"".join(map(self.known.__getitem__, self.words(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs that the ids name, with a space between them: the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Tokenizer] = {}


def _loaded(spec: str) -> Tokenizer:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = Tokenizer(spec)
    return _LOADED[spec]


def _mapped(df: DataFrame, column: str, outs: dict[str, str], spec: str, run_one) -> DataFrame:
    """df with column replaced by what run_one gives for it, of those names and types; batches are bounded in bytes."""
    spec_ = df.sparkSession.sparkContext.broadcast(spec)
    rest = [c for c in df.columns if c != column]
    schema = df.select(*rest, *(F.lit(None).cast(kind).alias(out) for out, kind in outs.items())).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(spec_.value)
        for b in batches:
            begin, made, size = 0, [], 0
            for k, x in enumerate(b.column(len(rest))):
                made.append(run_one(t, x.as_py()))
                size += sum(map(len, made[-1]))
                if size > 8 << 20 or k + 1 == b.num_rows:
                    kept = (b.column(c).slice(begin, len(made)) for c in range(len(rest)))
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, arrow.field(len(rest) + i).type) for i, c in enumerate(zip(*made, strict=True)))], schema=arrow)
                    begin, made, size = k + 1, [], 0

    return df.select(*rest, column).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) for each row of docs; ids are unsigned 32-bit integers, lowest byte first, end to end. decoded: and the text that the ids decode to, made in the same pass over the row.

    tokenizer is the path of a tokenizers file, read on the driver; workers get its text (bounded by the vocabulary) and compile it once.
    Null texts are empty and have no ids; whole texts are encoded; repeated rows are encoded each; an empty table gives no rows.
    Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    outs = {"ids": "binary", "decoded": "string"} if decoded else {"ids": "binary"}

    def one(t: Tokenizer, text: str) -> tuple:
        ids = t.encode(text)
        return (ids, t.decode(ids)) if decoded else (ids,)

    out = _mapped(base, "text", outs, Path(tokenizer).read_text(), one)
    return out.select("id", (F.length("ids") / 4).cast("long").alias("n_tokens"), *outs)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (id, n_tokens, ids) with the text that its ids decode to."""
    both = encoded.select("id", "n_tokens", "ids", F.col("ids").alias("coded"))
    return _mapped(both, "coded", {"decoded": "string"}, Path(tokenizer).read_text(), lambda t, x: (t.decode(x),))


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    out = digests(table(spark, sf_dir, "documents"), tokenizer)
    return out.withColumnRenamed("id", "doc_id")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = encode(docs, tokenizer, decoded=True)
    return out.select("id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
