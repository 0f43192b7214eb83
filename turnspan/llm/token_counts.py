"""Token counts kept as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a
document's count, a delete takes it away, a revision does both. Each batch of changes is summed by
key before it is written, so the table grows with batches and keys, not with documents, and totals
are one small aggregation. A batch is a folder named by its id; it counts from the moment that the
writer's success mark is there, and a batch that is already committed is left alone, so a batch that
is sent again, whole or after a failure half-way, changes nothing. `compact` folds the batches
committed so far into one base that names them.

Edge cases: a null text has no tokens but counts as a document; a null source, language or version
is a key of its own; a batch without changes is committed too; a batch id is bound to its first
committed content; repeated rows are as many documents; columns other than the named ones are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import small_batches

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabularies split text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 100_000


#: A worker's encoders by vocabulary: those of the vocabularies it counted last.
_encoders: dict[str, Callable[[str], list[int]]] = {}


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def encoders(contents: dict[str, bytes]) -> list[Callable[[str], list[int]]]:
    """An encoder for each vocabulary file (digest: content). A worker that runs many tasks builds
    each once and holds only those of its last call."""
    import tiktoken

    for digest in set(_encoders) - set(contents):
        del _encoders[digest]
    for digest, content in contents.items():
        if digest not in _encoders:
            _encoders[digest] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse_ranks(content), special_tokens={}).encode_ordinary
    return [_encoders[digest] for digest in contents]


def bpe_counts(texts: DataFrame, vocabulary: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """`texts` with the number of byte-level BPE tokens of each text, in place of the text, by the
    ranks in the file `vocabulary`."""
    return bpe_counts_by(texts, {out: vocabulary}, text_col)


def bpe_counts_by(texts: DataFrame, vocabularies: dict[str, str], text_col: str = "text") -> DataFrame:
    """`texts` with a column of token counts for each vocabulary file (column: path), in place of the
    text, which is sent to Python once for all of them. The files are read on the driver and sent to
    the tasks as they are: a vocabulary is of a fixed size."""
    files = {}
    for column, path in vocabularies.items():
        with open(path, "rb") as f:
            files[column] = f.read()
    digests = {column: hashlib.sha256(content).hexdigest() for column, content in files.items()}
    contents = small_batches(texts).sparkSession.sparkContext.broadcast({digests[column]: content for column, content in files.items()})
    names = [c for c in texts.columns if c != text_col]
    outs = list(vocabularies)
    order = [digests[column] for column in outs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_digest = dict(zip(contents.value, encoders(contents.value)))
        encode = [by_digest[digest] for digest in order]
        for batch in batches:
            counts = np.zeros((len(encode), batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(len(names))):
                text = text.as_py()
                if text:
                    for piece in pieces(text):
                        counts[:, i] += [len(one(piece)) for one in encode]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, counts)], names=[*[f"k{i}" for i in range(len(names))], *[f"n{i}" for i in range(len(encode))]])

    schema = ", ".join([f"k{i} {texts.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + [f"n{i} long" for i in range(len(outs))])
    ordered = texts.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("t"))
    return ordered.mapInArrow(run, schema).toDF(*names, *outs)


_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def pieces(text: str) -> Iterator[str]:
    """Parts of a long text whose counts add up to its own: cut before a space between two ASCII
    letters or digits, where a token never crosses (the space begins the next piece)."""
    at = 0
    while len(text) - at > CHUNK:
        found = _CUT.search(text, at + CHUNK)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def word_counts(texts: DataFrame, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """`texts` with the number of words of each text, in place of the text."""
    n = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return texts.withColumn(out, n).drop(text_col)


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of new documents: counts has the keys and n_tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(counts: DataFrame, new: str = "new_tokens") -> DataFrame:
    """Deltas of documents whose count changed from n_tokens to `new`; the keys stay. For changed
    keys, unite deletes and inserts."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col("n_tokens")).alias("tokens"))


class Rollup:
    """Totals under one folder, which all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.exists(p))

    def _names(self, kind: str) -> list[str]:
        """Names of the committed folders of a kind."""
        fs, p = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in found if self._exists(f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches it holds."""
        bases = self._names("bases")
        if not bases:
            return None, set()
        row = self.spark.read.parquet(f"{self.path}/bases/{bases[-1]}").select("batches").first()
        return bases[-1], set(json.loads(row.batches))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commits a batch of deltas (keys, docs, tokens); False if it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
            raise ValueError("a batch id has letters, digits, '.', '-' and '_' only")
        path = f"{self.path}/batches/{batch_id}"
        if self._exists(f"{path}/_SUCCESS") or batch_id in self._base()[1]:
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")
        summed.write.mode("overwrite").parquet(path)  # what a failed try has left goes
        return True

    def batches(self) -> list[str]:
        return sorted(set(self._names("batches")) | self._base()[1])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): the sums of all committed deltas, zeros left out."""
        base, held = self._base()
        paths = [f"{self.path}/batches/{n}" for n in self._names("batches") if n not in held]
        if base:
            paths.append(f"{self.path}/bases/{base}")
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into a new base; the old folders stay until `clean`."""
        names = self.batches()
        fs, p = self._fs(f"{self.path}/bases")
        numbers = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        n = max([int(x) for x in numbers if x.isdigit()], default=0) + 1  # never a name that was used, committed or not
        listed = F.lit(json.dumps(names))
        rows = self.totals().select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"), listed.alias("batches"))
        empty = self.spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"), listed.alias("batches"))
        rows.unionByName(empty).write.parquet(f"{self.path}/bases/{n:08d}")

    def clean(self) -> None:
        """Removes the folders that the newest base has made needless."""
        base, held = self._base()
        for kind, names in (("batches", [n for n in self._names("batches") if n in held]), ("bases", [n for n in self._names("bases") if n != base])):
            for name in names:
                fs, p = self._fs(f"{self.path}/{kind}/{name}")
                fs.delete(p, True)
