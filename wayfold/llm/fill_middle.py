"""Fill-in-middle: texts cut in three and put together in another order, with cuts found among runs of characters that are coded alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table

#: What stands before the prefix, the suffix and the middle.
MARKS = (b"<P>", b"<S>", b"<M>")
FORMS = ("plain", "psm", "spm")
#: Bytes of text whose runs are held at a time, but for a longer single text.
SPAN = 4 << 20


class Runs:
    """UTF-8 texts end to end, as maximal runs of code points of one width in bytes: where each run begins, in bytes and in code points counted from the first text.

    at(cut) searches the run that holds a cut, by halving, and gets the cut's byte by its distance in code points from the run's begin times the run's width.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """ends: the byte at which each text ends; a run may go on from text to text."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead]
        width = (1 + (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)).astype(np.int8)
        fresh = np.flatnonzero(np.diff(width, prepend=np.int8(0)))
        self.byte, self.unit, self.width = lead[fresh], fresh, width[fresh].astype(np.int64)
        #: code points before each text, and in all
        self.upto = np.concatenate([np.zeros(1, np.int64), self._units(ends, len(lead))])

    def _units(self, ends: np.ndarray, n: int) -> np.ndarray:
        if not len(self.byte):
            return np.zeros(len(ends), np.int64)
        run = np.maximum(np.searchsorted(self.byte, ends, "left") - 1, 0)
        return np.where(ends > 0, self.unit[run] + (ends - self.byte[run]) // self.width[run], 0)

    def at(self, unit: np.ndarray) -> np.ndarray:
        """The byte at which code point number `unit` begins; the end for their number."""
        if not len(self.unit):
            return np.zeros(len(unit), np.int64)
        run = np.searchsorted(self.unit, unit, "right") - 1
        return self.byte[run] + (unit - self.unit[run]) * self.width[run]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SPAN or k + 1 == len(texts):
            yield begin, k + 1
            begin, size = k + 1, 0


def transformed(texts: list[bytes], draws: list[np.ndarray], plain_percent: int, spm_percent: int) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """(code points, form, code points of the prefix, of the middle, output) of each text; draws: four arrays of whole numbers, one entry for each text."""
    h1, h2, h3, h4 = draws
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    runs = Runs(np.frombuffer(b"".join(texts), np.uint8), ends)
    before, n = runs.upto[:-1], np.diff(runs.upto)
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    begin = ends - sizes
    one, two = (runs.at(before + low) - begin).tolist(), (runs.at(before + high) - begin).tolist()
    form = np.where((h3 % 100 >= plain_percent) | (n == 0), 0, np.where(h4 % 100 < spm_percent, 2, 1)).tolist()
    p, s, m = MARKS
    for k, t in enumerate(texts):
        f = form[k]
        if not f or any(x in t for x in MARKS):
            yield int(n[k]), FORMS[0], None, None, t
            continue
        a, b, c = t[: one[k]], t[one[k] : two[k]], t[two[k] :]
        yield int(n[k]), FORMS[f], int(low[k]), int(high[k] - low[k]), b"".join((p, a, s, c, m, b) if f == 1 else (s, c, p, a, m, b))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made of. A text that holds a mark is plain, and no mark can begin or end within another, so each mark is found where it was put."""
    if form == FORMS[0]:
        return output
    p, s, m = MARKS
    one, rest = output.split(s if form == "psm" else p, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one[len(p) :], two) if form == "psm" else (two, one[len(s) :])
    return prefix + middle + suffix


def draws(id_: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2**32 that an id has: the first groups of eight digits of the SHA-256 of the seed, a colon and the id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _mapped(df: DataFrame, last: list[str], outs: dict[str, str], make) -> DataFrame:
    """df without its last columns and with what make gives for their values, chunk by chunk."""
    keep = [c for c in df.columns if c not in last]
    schema = df.select(*keep, *(F.lit(None).cast(kind).alias(name) for name, kind in outs.items())).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(len(keep) + i) for i in range(len(last))]
            texts = values[0].to_pylist()
            for a, b in _chunks(texts):
                made = zip(*make(texts[a:b], [v.slice(a, b - a) for v in values[1:]]), strict=True)
                kept = (batch.column(i).slice(a, b - a) for i in range(len(keep)))
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, arrow.field(len(keep) + i).type) for i, c in enumerate(made))], schema=arrow)

    return df.select(*keep, *last).mapInArrow(run, schema)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of docs: its whole text cut in three at two drawn code points.

    n is the number of code points. form psm is the prefix, the suffix, then the middle, each behind its mark; spm the suffix, the prefix, then the middle, which spm_percent of
    the transformed have; plain the text as it is: what isn't among plain_percent, empty texts, and texts that hold a mark. prefix_chars and middle_chars are null
    for these. output is UTF-8. Draws are by seed and id alone, so reruns agree; rows that share an id are cut at the same draws, each in its own text.

    Null texts are empty; a null id draws as an empty one; repeated rows are transformed each; an empty table gives no rows; other columns are not read.
    Texts are held a few MB at a time, and a longer one by itself; nothing is shuffled.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))))
    outs = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "binary"}

    def make(texts: list[bytes], hs: list[pa.Array]) -> Iterator[tuple]:
        return transformed(texts, [h.to_numpy(zero_copy_only=False) for h in hs], plain_percent, spm_percent)

    return _mapped(base, ["text", "h0", "h1", "h2", "h3"], outs, make)


def rebuilt(made: DataFrame, keep: bool = True) -> DataFrame:
    """made (…, form, output) with restored, the text as UTF-8, from these two columns alone; keep: with the output, too. Null outputs are empty texts."""
    base = made.withColumns({"of": F.coalesce("output", F.lit(b"")), "as": F.col("form")})
    return _mapped(base if keep else base.drop("output"), ["of", "as"], {"restored": "binary"}, lambda texts, forms: ((restored(t, f),) for t, f in zip(texts, forms[0].to_pylist(), strict=True)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    out = rebuilt(made, keep=False)
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLES = {
    "op11_fill_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t
), c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
