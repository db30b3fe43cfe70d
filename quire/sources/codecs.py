"""Codecs turn bytes of a file format into pages and back, in mapInPandas at the edge of the plan.

A codec is any object with decode(bytes) -> list of page texts and encode(list of page texts) -> bytes. TextCodec keeps
pages as UTF-8 between form feeds with form feeds and backslashes escaped. Codecs of real formats need libraries that
may be missing; they raise CodecMissing on first use and nothing else of the engine depends on them.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quire.workers import reach


class CodecMissing(RuntimeError):
    pass


class Codec(Protocol):
    def decode(self, content: bytes) -> list[str]: ...

    def encode(self, pages: list[str]) -> bytes: ...


class TextCodec:
    def decode(self, content: bytes) -> list[str]:
        plain = lambda s: s.replace("\\f", "\f").replace("\\\x00", "\\")
        return [plain(x.replace("\\\\", "\\\x00")) for x in content.decode().split("\f")]

    def encode(self, pages: list[str]) -> bytes:
        return "\f".join(x.replace("\\", "\\\\").replace("\f", "\\f") for x in pages).encode()


class PdfCodec:
    """PDF text by PyMuPDF, where it is installed."""

    def _library(self):
        if importlib.util.find_spec("fitz") is None:
            raise CodecMissing("PyMuPDF isn't installed")
        import fitz

        return fitz

    def decode(self, content: bytes) -> list[str]:
        with self._library().open(stream=content, filetype="pdf") as doc:
            return [page.get_text() for page in doc]

    def encode(self, pages: list[str]) -> bytes:
        with self._library().open() as doc:
            for text in pages:
                doc.new_page().insert_text((50, 50), text)
            return doc.tobytes(deflate=True)


def encode(documents: DataFrame, codec: Codec) -> DataFrame:
    """documents (doc_id, pages: array of (page, text)) as doc_id, content, error; a document that fails has an error
    and no content, and the job goes on."""
    reach(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content, error = [], []
            for pages in b["pages"]:
                try:
                    content.append(codec.encode([p["text"] or "" for p in pages]))
                    error.append(None)
                except CodecMissing:
                    raise
                except Exception as e:  # one document's fault
                    content.append(None)
                    error.append(str(e))
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": content, "error": error})

    return documents.select("doc_id", "pages").mapInPandas(run, "doc_id long, content binary, error string")


def decode(files: DataFrame, codec: Codec) -> DataFrame:
    """files (doc_id, content) as doc_id, page, text. Filter files by their length and pages by number before and after
    this node; nothing is pushed through it."""
    reach(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, t) for d, c in zip(b["doc_id"], b["content"], strict=True) if c is not None for i, t in enumerate(codec.decode(c), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page long, text string")
