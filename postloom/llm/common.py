"""What several operators share: words, row keys, label folds, batches, counts of a text."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"       # as bytes.split() without arguments cuts UTF-8
GAP = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 256                  # rows of one Arrow batch; texts may be long
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_marks", "n_points", "n_digits", "n_distinct", "n_adjacent")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(prefix: str, columns: list[str]) -> str:
    """A column name that ``columns`` lack, upper and lower case alike."""
    taken, name = {c.lower() for c in columns}, prefix
    while name.lower() in taken:
        name += "_"
    return name


def fields(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others the table has."""
    return docs.toDF(*[n if n in names else f"x{i}" for i, n in enumerate(docs.columns)]).select(*names)


def plainly(docs: DataFrame, work: Callable[[DataFrame], DataFrame],
            keep: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """``work`` on ``docs`` with all columns but ``keep`` named by their place, and the names put back on the result.

    So any name will do: reserved ones, names with back-ticks or dots, names that differ in case only.
    """
    names = docs.columns
    return work(docs.toDF(*[n if n in keep else f"x{i}" for i, n in enumerate(names)])).toDF(*names)


def map_texts(df: DataFrame, schema: str, work: Callable[[list[bytes]], dict[str, pa.Array]], text: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrow batches of ``df``: ``work`` turns the texts (UTF-8, null as empty) into new columns, one value per row.

    ``keep`` columns go through unchanged. Rows are cut into small batches, so memory follows the longest texts of
    one batch and not the partition.
    """
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                raw = [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
                made = work(raw)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(made.values()),
                                                 names=[*keep, *made])

    source = df.select(*keep, F.col(text).cast("string").alias(text))
    return source.mapInArrow(run, ", ".join([*kept, schema]))


def groups(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, but for a single longer value, ``most`` bytes of ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at:at + BATCH_ROWS], dtype=np.int64), most, "right")))
        yield batch.slice(at, n)
        at += n


def repeated_words(ids: np.ndarray, n: int = 3) -> int:
    """Words that lie in an ``n``-word window found twice or more; ``ids`` numbers the words from 0."""
    if len(ids) <= n:
        return 0
    code, top = ids.astype(np.int64), int(ids.max()) + 1
    for j in range(1, n):
        code = code[:-1] * top + ids[j:]
        code = np.unique(code, return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(n):
        covered[j:len(ids) - n + 1 + j] |= twice
    return int(covered.sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The values named in COUNTS, for one text."""
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = int(of[9:14].sum() + of[32])
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    return (len(words), len(raw) - int(of[128:192].sum()) - space, int(of[list(b"#*$%&|<>")].sum()),
            len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, upper + lower,
            int(of[33] + of[63]), int(of[44] + of[46]), int(of[48:58].sum()), len(number), sum(map(eq, words, words[1:])))


def with_counts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and one long column for each of COUNTS; null text counts as empty."""
    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        made = np.array([counts_of(x) for x in raw], np.int64).reshape(len(raw), len(COUNTS))
        return {name: pa.array(made[:, i]) for i, name in enumerate(COUNTS)}

    return map_texts(docs, ", ".join(f"{c} long" for c in COUNTS), work, keep=keep)


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Counts to roughly normal statistics: logs of smoothed rates, one column each."""
    x = {k: np.asarray(c[k], float) for k in COUNTS}
    n = x["n_words"]
    return np.column_stack([
        np.log1p(n),
        np.log((x["word_chars"] + 5) / (n + 1)),
        np.log((x["n_upper"] + 1) / (x["n_letters"] + 40)),
        np.log((x["n_symbols"] + 0.25) / (n + 10)),
        np.log((x["n_marks"] + 0.25) / (n + 10)),
        np.log((x["n_points"] + 1) / (n + 10)),
        np.log((x["n_digits"] + 0.5) / (x["word_chars"] + 40)),
        np.log((x["n_distinct"] + 1) / (n + 1)),
        np.log((x["n_dup_lines"] + 0.1) / (x["n_lines"] + 1)),
        np.log((x["n_repeat_words"] + 1) / (n + 10)),
        np.log((x["n_adjacent"] + 0.25) / (n + 10)),
        np.log((n + 1) / (x["n_lines"] + 1)),
    ])


STATISTICS = 12
