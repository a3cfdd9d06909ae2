"""Tables of distinct text chunks, each encoded once by the tokenizer library.

Both tokenizers used here never join characters across certain places of a text, so a text's ids are
the ids of its chunks in a row. The tables live in a task; they hold a bounded number of chunks and
forget the ones not met for longest, which costs time and never changes an id.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TABLE_CHUNKS = 400_000     # per generation; two generations are held
JOINED = 2_048             # chunks that are handed to the library as one text
_STORE = "_canopyframe_chunk_tables"

# A word and the marks after it are two pre-tokens, so marks need no entries for every word.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?#*$%&]"
_WORD_AND_MARKS = re.compile(f"({_LETTERS})({_MARKS}+)")
# So are, after a line's last word and its marks, the line end, the next line's first word and its marks.
_WORDS = f"^(?P<word>{_LETTERS})(?P<marks>{_MARKS}*)(?:\n(?P<next>{_LETTERS})(?P<after>{_MARKS}*))?$"
# A blank beside one of these, or another blank (or at a text's edge) isn't where a pre-token must begin.
_PLAIN_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_BESIDE = [(c, " " + c, c + " ") for c in _PLAIN_SPACES]
_OTHER_SPACES = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B)))
_EDGE = re.compile(r"(?<=\S) (?=\S)")
_UNIT = re.compile(r" +[^ ]*")


def tokenizer_bytes(name: str, path: str | None = None) -> bytes:
    """The vocabulary file; ``path`` wins over the installed file called ``name``."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(name)
    return Path(path).read_bytes()


def _listed(run: Callable[[list[str]], list[bytes]]) -> Callable[[pa.Array], pa.Array]:
    return lambda column: pa.array(run(column.to_numpy(zero_copy_only=False).tolist()),
                                   pa.large_binary())


def _together(left: pa.Array, right: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(left, right, pa.scalar(b"", pa.large_binary()))


def _by_value(column: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """What ``run`` gives for each value, run on the distinct ones."""
    column = column.dictionary_encode()
    return run(column.dictionary).take(column.indices)


class ChunkTable:
    """chunk -> value, filled in groups by ``fill``; a missing chunk may come from the older half."""

    def __init__(self, limit: int = TABLE_CHUNKS):
        self.limit, self.new, self.old = limit, {}, {}

    def fill(self, chunks: list[str]) -> list:
        raise NotImplementedError

    def values(self, chunks: list[str]) -> list:
        new = self.new
        out = list(map(new.get, chunks))
        if None in out:
            old, missing = self.old, []
            holes = [k for k, v in enumerate(out) if v is None]
            for chunk in {chunks[k] for k in holes}:
                value = old.get(chunk)
                if value is None:
                    missing.append(chunk)
                else:
                    new[chunk] = value
            if missing:
                new.update(zip(missing, self.fill(missing)))
            for k in holes:
                out[k] = new[chunks[k]]
            if len(new) > self.limit:
                self.old, self.new = new, {}
        return out


def shared_table(kind: type[ChunkTable], model: bytes) -> ChunkTable:
    """The worker process's table for this model: a later task goes on with what an earlier one has
    encoded."""
    store = sys.modules.setdefault(_STORE, ModuleType(_STORE))
    name = f"{kind.__name__}{zlib.crc32(model)}"
    if not hasattr(store, name):
        setattr(store, name, kind(model))
    return getattr(store, name)


def forget_tables() -> None:
    """Free the worker process's tables, for tasks that have no use for them."""
    sys.modules.pop(_STORE, None)


class LineStarts(ChunkTable):
    """Words that follow a line end; values are the ids of both."""

    def __init__(self, joined: Callable[[list[str], str], list[bytes]], limit: int):
        super().__init__(limit)
        self.joined = joined

    def fill(self, chunks: list[str]) -> list[bytes]:
        return [v for at in range(0, len(chunks), JOINED)
                for v in self.joined(chunks[at:at + JOINED], "\n")]


class ByteChunks(ChunkTable):
    """Byte-level BPE. A blank between two visible characters always starts a pre-token, so a text
    may be cut before it. Values are the ids as little-endian 16-bit bytes (the vocabulary is
    smaller than 65,536; checked)."""

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS):
        super().__init__(limit)
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model.decode())
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids do not fit into 16 bits")
        self.marks: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.lines = LineStarts(self._joined, limit // 8)
        # Characters of a token's name stand for bytes, so their number tells how far it reaches.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token)

    @staticmethod
    def _every_blank_cuts(text: str) -> bool:
        return not (text[0] == " " or text[-1] == " " or "  " in text
                    or any(c in text and (before in text or after in text)
                           for c, before, after in _BESIDE)
                    or not text.isascii() and any(c in text for c in _OTHER_SPACES))

    def chunks(self, text: str) -> list[str]:
        """The text's chunks; all but the first have lost their leading blank."""
        return text.split(" ") if self._every_blank_cuts(text) else _EDGE.split(text)

    def fill(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        plain, split = [], []
        for k, chunk in enumerate(chunks):
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                out[k] = self.one(" " + chunk)      # at a text's edge, or beside it: on its own
            elif match := _WORD_AND_MARKS.fullmatch(chunk):
                split.append((k, *match.groups()))
            else:
                plain.append(k)
        for at in range(0, len(plain), JOINED):
            group = plain[at:at + JOINED]
            out_of = self._joined([chunks[k] for k in group])
            for k, value in zip(group, out_of):
                out[k] = value
        if split:
            # The words go through the table again, now without marks.
            words = self.values([w for _, w, _ in split])
            for (k, _, marks), word in zip(split, words):
                out[k] = word + self._mark(marks)
        return out

    def _marks(self, found: list[str]) -> list[bytes]:
        return [self._mark(marks) if marks else b"" for marks in found]

    def _mark(self, marks: str) -> bytes:
        tail = self.marks.get(marks)
        if tail is None:
            tail = self.one(marks)
            if len(self.marks) < self.limit:
                self.marks[marks] = tail
        return tail

    def _joined(self, group: list[str], before: str = " ") -> list[bytes]:
        text = before + before.join(group)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                       np.int64)
        size = [len(c) + 1 for c in group] if text.isascii() else [len(c.encode()) + 1 for c in group]
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size)) + 1
        data = ids.astype("<u2").tobytes()
        out, at = [], 0
        for cut in (2 * cuts).tolist():
            out.append(data[at:cut])
            at = cut
        return out

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; a chunk that is in them often is looked up once, what is new goes to
        the library together."""
        out, order, tails, others, rest = [b""] * len(texts), [], [], [], []
        for k, text in enumerate(texts):
            if text and self._every_blank_cuts(text):
                head, blank, tail = text.partition(" ")
                out[k] = self._start(head)
                if blank:
                    order.append(k)
                    tails.append(tail)
            elif text:
                others.append(k)
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        counts = np.diff(split.offsets.to_numpy()).tolist()
        for k in others:
            head, *own = _EDGE.split(texts[k])
            out[k] = self._start(head)
            rest += own
            counts.append(len(own))
        order += others
        ids = _by_value(pa.concat_arrays([split.flatten(), pa.array(rest, pa.large_string())]),
                        self._of_distinct)
        _, places, data = ids.buffers()
        if data is not None:
            places = np.frombuffer(places, np.int64)
            data, ends = memoryview(data), np.cumsum([0] + counts)
            for k, a, b in zip(order, places[ends[:-1]].tolist(), places[ends[1:]].tolist()):
                out[k] += data[a:b]
        return out

    def _of_distinct(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks: words come from the table without the marks around them."""
        parts = pc.extract_regex(chunks, _WORDS)
        word, marks, follower, after = (pc.struct_field(parts, k) for k in range(4))
        out = _together(_by_value(pc.coalesce(word, chunks), _listed(self.values)),
                        _by_value(pc.fill_null(marks, ""), _listed(self._marks)))
        more = np.flatnonzero(pc.greater(pc.binary_length(pc.fill_null(follower, "")), 0))
        if len(more):
            place = np.full(len(chunks), -1, np.int64)
            place[more] = np.arange(len(more))
            more = pa.array(more)
            lines = _together(_by_value(follower.take(more), _listed(self.lines.values)),
                              _by_value(after.take(more), _listed(self._marks)))
            out = _together(out, pc.fill_null(lines.take(pa.array(place, mask=place < 0)), b""))
        return out

    def _start(self, chunk: str) -> bytes:
        """Ids of a text's first chunk, which has no blank before it."""
        if not chunk:
            return b""
        known = self.starts.get(chunk)
        if known is None:
            known = self.one(chunk)
            if len(self.starts) > self.limit // 4:
                self.starts.clear()
            self.starts[chunk] = known
        return known


class PieceChunks(ChunkTable):
    """SentencePiece BPE whose pieces hold the blank mark at their beginning only (checked), so a
    run of blanks and the word after it are segmented on their own. Values are the ids as
    little-endian 16-bit bytes (the vocabulary is smaller than 65,536; checked), for a unit that the
    library decodes to something else together with that."""

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS // 2):
        super().__init__(limit)
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece crosses a blank mark; distinct chunks cannot be used")
        if len(pieces) > 65_536:
            raise ValueError("ids do not fit into 16 bits")
        self.blank = self.model.piece_to_id("▁")
        self.end = self.model.eos_id()
        self.names = [str(k) for k in range(len(pieces))]

    def fill(self, units: list[str]) -> list[bytes | tuple[bytes, str]]:
        """``units`` lack their first blank, which the library adds itself."""
        out: list[bytes | tuple[bytes, str]] = []
        for unit, ids in zip(units, self.model.encode(units, num_threads=1)):
            if not unit:
                ids = [self.blank]
            value, back = np.array(ids, "<u2").tobytes(), self.model.decode(ids)
            out.append(value if back == unit else (value, back))
        return out

    def encode(self, text: str) -> tuple[str, bytes, str]:
        """(ids as text, ids as 32-bit bytes, decoded text), with the end id."""
        if not text:
            return str(self.end), np.array([self.end], "<i4").tobytes(), ""
        text = text.replace("▁", " ")
        units = text.split(" ")
        if "" in units:
            units = [u[1:] for u in _UNIT.findall(" " + text)]
        values = self.values(units)
        if tuple in set(map(type, values)):
            for k, value in enumerate(values):
                if type(value) is tuple:
                    values[k], units[k] = value
        ids = np.frombuffer(b"".join(values) + np.array([self.end], "<u2").tobytes(), "<u2")
        names = " ".join(map(self.names.__getitem__, ids.tolist()))
        return names, ids.astype("<i4").tobytes(), " ".join(units)
