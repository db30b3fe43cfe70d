"""Token counts without moving pre-tokens: a two-tier lookup in each worker.

Tier one is a broadcast table of the lengths of the most frequent pre-tokens, at most FREQUENT entries of at most
LONGEST_KEY bytes, so below 3 MB for any corpus. Tier two is a worker's own cache of the pre-tokens that it has had to
encode, in two generations of at most CACHE; it lives as long as the worker, over all its tasks. A pre-token is a run of spaces with what follows it up to the next space: no piece of the
vocabulary goes on across such a border (checked when the model is loaded), so lengths of pre-tokens add up exactly.

The table comes from a pass over all texts: each partition counts its pre-tokens and hands on its HEAD most frequent.
Which pre-tokens are in it changes the speed, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import pieces, texts

LIMIT = 4096
FREQUENT, LONGEST_KEY, HEAD = 65_536, 32, 8_192
CACHE = 150_000
_SPACE = "▁"
_GROUP = re.compile(" +[^ ]*")


class Lengths:
    """Numbers of pieces as the library gives them for whole texts."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.additive = _SPACE in names and not any(_SPACE in x.lstrip(_SPACE) for x in names) and self.model.encode("a b", out_type=str)[0].startswith(_SPACE)
        self.use(frequent, None)

    def use(self, frequent: dict[str, int], ident: int | None) -> None:
        """Takes a table for tier one, known by its broadcast's number, and empties tier two."""
        # "": a single space at the end; the library's own first space doesn't come alone
        self.frequent, self.ident = frequent | {"": 1}, ident
        self.table, self.before = {}, {}

    @classmethod
    def shared(cls, path: str, ident: int, frequent: dict[str, int]) -> Lengths:
        """One for each worker process."""
        one = tokens._loaded.get((cls, path))
        if one is None:
            one = tokens._loaded[cls, path] = cls(path, {})
        if one.ident != ident:
            one.use(frequent, ident)
        return one

    def _groups(self, text: str) -> list[str]:
        """Pre-tokens without their first space, which the library puts before every text itself."""
        return text.split(" ") if "  " not in text and text[:1] != " " and text[-1:] != " " else [x[1:] for x in _GROUP.findall(" " + text)]

    def count(self, texts_: list[str]) -> list[int]:
        whole = [i for i, x in enumerate(texts_) if not self.additive or _SPACE in x]
        cut = [self._groups(x) if x else [] for x in texts_]
        for i in whole:
            cut[i] = []
        rare = set().union(*cut).difference(self.frequent)
        missing = rare.difference(self.table)
        if len(self.table) + len(missing) > CACHE:
            self.table, self.before = {}, self.table
            missing = rare
        again = missing.intersection(self.before)
        self.table.update((x, self.before[x]) for x in again)
        missing = list(missing - again)
        self.table.update(zip(missing, map(len, self.model.encode(missing, num_threads=1)), strict=True))
        get, often = self.table.get, self.frequent.get
        # a pre-token has one piece at least, so a length is never 0
        out = [sum(often(x) or get(x) for x in parts) for parts in cut]
        for i in whole:
            out[i] = len(self.model.encode(texts_[i]))
        return out


def frequent(docs: DataFrame, path: str) -> dict[str, int]:
    """Tier one: the FREQUENT most frequent pre-tokens by the partitions' heads, with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for b in pieces(batch):
                for text in b.column("text").to_pylist():
                    seen.update(text.split(" "))
                if len(seen) > 8 * FREQUENT:  # the rare ones are not what the table is for
                    seen = Counter(dict(seen.most_common(FREQUENT)))
        head = [(k, v) for k, v in seen.most_common(HEAD) if 0 < len(k.encode()) <= LONGEST_KEY]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in head], pa.string()), pa.array([v for _, v in head], pa.int64())], ["piece", "n"])

    heads = docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    found = [r["piece"] for r in heads.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").collect()]
    return dict(zip(found, Lengths(path, {}).count(found), strict=True)) if found else {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every text; a null text counts as empty.
    One row per row, also for equal doc_ids; an empty table gives no rows. Other columns are not looked at. A text of any
    length is counted whole, and its pre-tokens are held in memory."""
    path = path or tokens.vocabulary("piece_bpe_32k.model")
    docs = texts(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))
    ident = id(table) if table._jbroadcast is None else table._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.shared(path, ident, table.value)
        for batch in batches:
            for b in pieces(batch):
                n = pa.array(lengths.count(b.column("text").to_pylist()), pa.int64())
                size = pc.binary_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
