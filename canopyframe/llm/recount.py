"""Token counts that follow edits: a sum tree of chunk counts per document, updated where it is hit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.chunks import ByteChunks, shared_table, tokenizer_bytes

MODEL = "byte_bpe_50k.json"
EDIT = "array<struct<start:int,stop:int,replacement:string>>"

# Personal data to be masked, in order of precedence where two begin at one place.
MASKS = [
    ("<email>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("<url>", r"https?://[^\s<>\"']+"),
    ("<address>", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("<number>", r"\+?\d[\d ().-]{5,}\d"),
    ("<key>", r"\b(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{20,}\b"),
]


class CountTree:
    """Segment tree over the chunks of a text: each node has the characters and tokens below it.

    A leaf is a chunk: a stretch of pre-tokens that begins before a blank between two visible
    characters, where a pre-token always begins. An edit re-encodes the leaves it touches and the
    whole leaf on either side (so that both outer borders stay such places), puts the new stretch
    into the first of them, empties the others and corrects the sums on their paths to the root.
    """

    def __init__(self, table: ByteChunks, text: str):
        self.table = table
        first, *rest = table.chunks(text) if text else [""]
        self.leaves = [first, *(" " + c for c in rest)]
        counts = [len(v) // 2 for v in table.values(rest)]
        counts.insert(0, len(table.one(first)) // 2 if first else 0)
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.tokens = self._sums(counts)
        self.chars = self._sums([len(x) for x in self.leaves])
        self.encoded_chars = 0

    def _sums(self, values: list[int]) -> np.ndarray:
        tree = np.zeros(2 * self.size, np.int64)
        tree[self.size:self.size + len(values)] = values
        level = self.size
        while level > 1:
            tree[level // 2:level] = tree[level:2 * level:2] + tree[level + 1:2 * level:2]
            level //= 2
        return tree

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds a character, characters before that leaf)."""
        node, before, chars = 1, 0, self.chars
        while node < self.size:
            node *= 2
            if place >= before + chars[node]:
                before += int(chars[node])
                node += 1
        return node - self.size, before

    def _beside(self, leaf: int, step: int) -> int | None:
        """The nearest leaf with text on one side, by way of the tree's sums."""
        node = leaf + self.size
        while node > 1:
            sibling = node ^ 1
            if (sibling > node) == (step > 0) and self.chars[sibling] > 0:
                node = sibling
                while node < self.size:
                    near = 2 * node + (0 if step > 0 else 1)
                    node = near if self.chars[near] > 0 else near ^ 1
                return node - self.size
            node //= 2
        return None

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        more_chars = len(text) - int(self.chars[leaf + self.size])
        more_tokens = tokens - int(self.tokens[leaf + self.size])
        self.leaves[leaf] = text
        node = leaf + self.size
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, stop: int, replacement: str) -> int:
        """Replace characters [start, stop) of the text as it is now; gives the tokens after it."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        if total == 0:
            a = b = 0
            before = 0
        else:
            a, before = self.find(min(start, total - 1))
            b, _ = self.find(min(max(stop - 1, start), total - 1))
            left = self._beside(a, -1)
            if left is not None:
                before -= len(self.leaves[left])
                a = left
            right = self._beside(b, 1)
            b = b if right is None else right
        touched = []
        leaf: int | None = a
        while leaf is not None and leaf <= b:
            touched.append(leaf)
            leaf = self._beside(leaf, 1)
        old = "".join(self.leaves[k] for k in touched)
        new = old[:start - before] + replacement + old[stop - before:]
        self.encoded_chars += len(new)
        self._put(a, new, self._count(new))
        for leaf in touched[1:]:
            self._put(leaf, "", 0)
        return self.n_tokens

    def _count(self, text: str) -> int:
        """Tokens of a stretch, its inner chunks through the table."""
        if not text:
            return 0
        if text[0] == " " and len(text) > 1 and not text[1].isspace():
            return sum(len(v) for v in self.table.values(self.table.chunks(text[1:]))) // 2
        return len(self.table.encode(text)) // 2

    def text(self) -> str:
        return "".join(self.leaves)


def mask_edits(text: str) -> list[dict]:
    """Edits that mask personal data, left to right; places are those of the unedited text."""
    found = sorted((m.start(), rank, m.end(), name) for rank, (name, pattern) in enumerate(MASKS)
                   for m in re.finditer(pattern, text))
    out, free = [], 0
    for start, _, stop, name in found:
        if start >= free:
            out.append({"start": start, "stop": stop, "replacement": name})
            free = stop
    return out


def with_mask_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edits): from last to first, so that earlier places stay valid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()),
                                   ("replacement", pa.string())]))
        for batch in batches:
            edits = [mask_edits(t.as_py() or "")[::-1] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)],
                                             ["id", "text", "edits"])

    return (docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
            .mapInArrow(run, f"id long, text string, edits {EDIT}")
            .withColumnsRenamed({"id": id_col, "text": text_col}))


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its rows of ``edits`` (id, edit_no, start, stop, replacement) as a column.

    Edits of one document are applied in the order of ``edit_no``; each place counts characters of
    the text as it is then. Documents without edits get none.
    """
    each = edits.groupBy(F.col(id_col).alias("_id")).agg(F.expr(
        "transform(array_sort(collect_list(struct(edit_no, start, stop, replacement))), "
        f"e -> struct(e.start, e.stop, e.replacement))").cast(EDIT).alias("edits"))
    return docs.drop("edits").join(each, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  edits_col: str = "edits", model_path: str | None = None) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, encoded_chars, chars_after) per row.

    ``n_tokens`` counts the ids of the whole text, ``n_tokens_after`` those after all its edits,
    which are applied in turn to a tree of chunk counts; ``encoded_chars`` says how many characters
    the edits had to encode again.

    A null text counts as empty and can be edited; null or missing edits are none; a null edit is
    skipped; a null replacement deletes; places outside the text are moved to its nearest end.
    Repeated rows repeat, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(MODEL, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_table(ByteChunks, model.value)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                tree = CountTree(table, text.as_py() or "")
                before, done = tree.n_tokens, 0
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                        done += 1
                rows.append((before, done, tree.n_tokens, tree.encoded_chars, int(tree.chars[1])))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in columns)],
                ["id", "n_tokens", "n_edits", "n_tokens_after", "encoded_chars", "chars_after"])

    return (docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text",
                            f"`{edits_col}` as edits")
            .mapInArrow(run, "id long, n_tokens long, n_edits long, n_tokens_after long, "
                             "encoded_chars long, chars_after long")
            .withColumnRenamed("id", id_col))
