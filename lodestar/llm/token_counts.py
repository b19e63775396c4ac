"""Token counts with sentencepiece: lengths only, in batches of about equal bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import prepare, resident

#: A single space after and before a visible Latin or ASCII character. Pieces of the model hold a space at
#: their start only (or are spaces alone), so nothing is merged across such a place.
_SAFE = re.compile("(?<=[!-~\xa1-ɏ]) (?=[!-~\xa1-ɏ])")


def processor(path: str):
    import sentencepiece

    return resident(("sentencepiece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def parts_of(text: str, limit: int) -> list[str]:
    """Cuts a text of over limit characters at safe spaces and drops the space itself: the library sets one
    before each text, so the parts' lengths add up to the length of the whole."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def lengths(model, texts: list[str], batch_bytes: int, part_chars: int) -> np.ndarray:
    """Tokens of each text; each call of the library gets about batch_bytes of UTF-8."""
    total = np.zeros(len(texts), np.int64)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        if batch:
            np.add.at(total, owner, [len(x) for x in model.encode(batch, num_threads=1)])
            batch.clear()
            owner.clear()

    for i, t in enumerate(texts):
        for p in parts_of(t, part_chars):
            batch.append(p)
            owner.append(i)
            held += len(p) if p.isascii() else len(p.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, batch_bytes: int = 1 << 18, part_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. A null or empty text has 0 bytes and 0 tokens.
    Repeated rows stay; other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)

    def run(batches):
        model = processor(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = lengths(model, texts, batch_bytes, part_chars)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    t = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
