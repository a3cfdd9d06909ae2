"""SentencePiece ids of whole texts through a table of distinct marked words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyframe.llm.chunks import PieceChunks, shared_table, tokenizer_bytes
from canopyframe.llm.common import give_back

MODEL = "piece_bpe_32k.model"


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: (id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    Ids are those of the library with an end id; ``decoded_sha256`` is over the library's decoding
    of them. A text is cut where no piece can cross, every distinct chunk that a task meets is
    segmented once, and the ids are joined back by place. Nothing is shuffled.

    A null text counts as empty (only the end id); a null id stays null; rows that repeat give rows
    that repeat; other columns are ignored; an empty table gives an empty table. The blank mark
    itself reads as a blank, as in the library.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(MODEL, model_path))
    fields = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_table(PieceChunks, model.value)
        for batch in batches:
            counts, shas, decoded, all_ids = [], [], [], []
            for text in batch.column(1):
                names, ids, back = table.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                shas.append(hashlib.sha256(names.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                       pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0] + counts).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    out = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text").mapInArrow(
        run, fields + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)
