"""Encoders as data: a registry of models, routing of queries and documents, and encoding by any function on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.sources.tables import require


@dataclass(frozen=True)
class Model:
    """A public text encoder. article is the checkpoint for documents where that is another one; such pairs take no prefix and the first token."""

    key: str
    checkpoint: str
    objective: str
    pooling: str
    query_prefix: str = ""
    document_prefix: str = ""
    article: str | None = None

    def route(self, side: str) -> tuple[str, str, str]:
        """(checkpoint, pooling, prefix) of the query or document side."""
        if self.article:
            return (self.checkpoint if side == "query" else self.article), "cls", ""
        return self.checkpoint, self.pooling, self.query_prefix if side == "query" else self.document_prefix


#: The models that are compared.
REGISTRY = (
    Model("bge", "BAAI/bge-base-en-v1.5", "contrastive", "cls", "Represent this sentence for searching relevant passages: "),
    Model("gte", "thenlper/gte-base", "contrastive", "mean"),
    Model("e5", "intfloat/e5-base-v2", "contrastive", "mean", "query: ", "passage: "),
    Model("nomic", "nomic-ai/nomic-embed-text-v1.5", "contrastive", "mean", "search_query: ", "search_document: "),
    Model("mpnet", "sentence-transformers/all-mpnet-base-v2", "contrastive", "mean"),
    Model("minilm", "sentence-transformers/all-MiniLM-L6-v2", "contrastive", "mean"),
    Model("medcpt", "ncbi/MedCPT-Query-Encoder", "contrastive", "cls", article="ncbi/MedCPT-Article-Encoder"),
    Model("biolord", "FremyCompany/BioLORD-2023", "contrastive", "mean"),
    Model("bert-base", "bert-base-uncased", "masked", "cls"),
    Model("biobert", "dmis-lab/biobert-v1.1", "masked", "cls"),
    Model("clinicalbert", "medicalai/ClinicalBERT", "masked", "cls"),
    Model("pubmedbert", "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext", "masked", "cls"),
    Model("scibert", "allenai/scibert_scivocab_uncased", "masked", "cls"),
)


def windows(n: int, prefix: int, limit: int = 510, stride: int = 384) -> list[tuple[int, int]]:
    """(start, stop) of the body windows of a text of n tokens; the prefix stands before each and takes its room; an empty text has one."""
    body = limit - prefix
    step = min(stride, body)
    return [(a, min(a + body, n)) for a in range(0, max(1, step * -(-(n - body) // step) + 1), step)]


def encoded(df: DataFrame, id_column: str, text: str, encode: Callable[[list[str]], np.ndarray], dim: int, prefix: str = "", limit: int = 510, stride: int = 384, batch: int = 256) -> DataFrame:
    """One unit vector per window of words of each text: id, chunk, v. encode takes texts and returns (texts, dim); null texts are left out.

    The model is loaded where encode is first called, once per worker; batches of `batch` windows bound its memory.
    """
    require(df, [id_column, text])
    kind = df.schema[id_column].dataType.simpleString()
    ahead = len(prefix.split())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, chunk, parts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = t.split()
                for k, (a, z) in enumerate(windows(len(words), ahead, limit, stride)):
                    at.append(i)
                    chunk.append(k)
                    parts.append(prefix + " ".join(words[a:z]))
            for lo in range(0, len(parts), batch):
                v = np.asarray(encode(parts[lo : lo + batch]), np.float64)
                v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[lo : lo + batch])), pa.array(chunk[lo : lo + batch], pa.int32()), flat], ["id", "chunk", "v"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    return rows.mapInArrow(of, f"id {kind}, chunk int, v array<float>").withColumnRenamed("id", id_column)
