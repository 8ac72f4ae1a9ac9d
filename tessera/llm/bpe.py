"""Byte-level BPE encoding and decoding (operator 4).

Encoding. A text is cut by the vocabulary's pattern; each match is run, byte by byte, through a finite-state
transducer compiled from the ranks.  The transducer is determinised lazily: a state is the bytes that are still undecided and what
of the last token emitted can still matter to them, and a transition is worked out when it is first taken.  It rests on
two facts about BPE: (1) a token sequence is the encoding of its bytes exactly if each neighbouring pair is the
encoding of that pair's bytes, so that each prefix of a piece has one last token; (2) a token that is still to come
must begin where the bytes read since then are the beginning of some vocabulary entry.  A boundary that all those
places have in common can't change any more, so the tokens before it are emitted: lookahead is bounded by the longest
vocabulary entry.  As in the public library, a piece that is itself an entry is that one token.

Decoding. Ids come in any portions and give text as soon as it is certain: the state between portions is the unfinished UTF-8
sequence (three bytes at most).  Bytes that can't begin or continue a character give U+FFFD, one for each maximal ill-formed part,
by a byte-level UTF-8 automaton; portions that are well-formed up to their unfinished end are decoded as a whole.

Edge cases: a null text is encoded as the empty text (no ids); an empty text has no ids; null ids decode to an empty
text; an id outside the vocabulary raises ValueError.  Rows are independent: repeated rows stay, other columns pass
through, and the added columns get underscores in front where their names are taken.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import column_names, in_arrow, no_cycles, worker_tables

#: Moves that a transducer's table may hold, and pieces that a generation of the cache may; beyond it they start anew.
#: Smaller numbers take less memory (about 115 MB a worker as they are, over the vocabulary) and more time; results don't change.
TABLE_LIMIT = 300_000
PIECE_LIMIT = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class BpeTransducer:
    """Lazily determinised transducer from the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], limit: int = TABLE_LIMIT):
        self.ranks, self.limit = ranks, limit
        self.own = {token: token for token in ranks}  # tables share these objects
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._restart()

    def _restart(self) -> None:
        """Only the start state: nothing emitted, nothing undecided."""
        #: Undecided bytes; what is left of them, then the last token up to each place among them, where it matters; the places
        #: where a token to come may begin.
        self.states: list[tuple[bytes, tuple, tuple[int, ...]]] = [(b"", ((),), (0,))]
        self.number = {self.states[0][:2]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.emits: dict[tuple[int, ...], tuple[int, ...]] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token's last merge; (b"", b"") for one byte, None if merging its bytes doesn't give the token."""
        if token not in self.halves:
            parts, two = [token[i : i + 1] for i in range(len(token))], (b"", b"")
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                two = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = two if len(parts) == 1 else None
        return self.halves[token]

    def _age(self, token: bytes) -> int:
        return self.ranks[token] if len(token) > 1 else -1

    def _right_edge(self, token: bytes) -> tuple[tuple[bytes, int, bool], ...]:
        """The token, its right half, that one's right half and so on, each with the rank of the merge that ends it."""
        edge, due = [], 1 << 60
        while token:
            edge.append((token, due, False))
            due, token = self.ranks[token], self._halves(token)[1]
        return tuple(edge)

    def _spoiled(self, edge: tuple[tuple[bytes, int, bool], ...], right: bytes) -> bool:
        """Whether BPE, with ``edge`` to the left of the token ``right``, merges across the boundary.

        It does if some part on the left stands next to some left part of ``right`` when the merge of the two is due: both are
        there already and neither has been merged further (for the one on the right also at the same rank: the leftmost goes first).
        """
        part, due = right, 1 << 60
        while part and edge:
            age = self._age(part)
            for other, end, _ in edge:
                if end > age and due >= self._age(other) and self.ranks.get(other + part, 1 << 60) < min(end, due + 1):
                    return True
            due, part = self.ranks[part], self._halves(part)[0]
        return False

    def _follows(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the tokens ``left`` and ``right`` side by side."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._halves(right) is not None and not self._spoiled(self._right_edge(left), right)
            if len(self.fits) >= self.limit // 4:
                self.fits.clear()
            self.fits[left, self.own[right]] = known
        return known

    def _narrowed(self, edge: tuple[tuple[bytes, int, bool], ...], window: bytes, at: int) -> tuple[tuple[bytes, int, bool], ...]:
        """What of ``edge`` can spoil a token that begins with ``window``: a merge with a beginning of the window in time, or one
        with more than the window.  ``at``: how many bytes of the window have been looked at."""
        kept = []
        for part, due, sure in edge:
            sure = sure or any(self.ranks.get(part + window[:n], due) < due for n in range(at + 1, len(window) + 1))
            if sure or part + window in self.prefixes:
                kept.append((part, due, sure))
        return tuple(kept)

    def _compile(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        window, lasts, live = self.states[state]
        window += bytes((byte,))
        size, last, still = len(window), None, []
        for begin in live:
            token = window[begin:]
            if last is None and token in self.ranks:
                if self._follows(lasts[begin], token) if begin else self._halves(token) is not None and not self._spoiled(lasts[0], token):
                    last = self.own[token]
            if token in self.prefixes:
                still.append(begin)
        still.append(size)
        lasts = (*lasts, last)
        # The boundaries up to each place form a tree; what lies before the last one that all live places share is decided.
        open_ = set(still)
        while len(open_) > 1:
            end = max(open_)
            open_.discard(end)
            open_.add(end - len(lasts[end]))
        cut = at = open_.pop()
        done = []
        while at:
            done.append(self.ranks[lasts[at]])
            at -= len(lasts[at])
        emitted = tuple(reversed(done))
        # A place that no live one's boundaries touch doesn't matter, nor what is left of the window where no token can begin
        # there or be spoiled by it: forgetting them merges states.
        kept: list[Any] = [None] * (size - cut + 1)
        for end in still:
            while end > cut and kept[end - cut] is None:
                kept[end - cut] = lasts[end]
                end -= len(lasts[end])
        kept[0] = ()
        if still[0] == cut:
            kept[0] = self._narrowed(self._right_edge(lasts[cut]), window[cut:], 0) if cut else lasts[0] and self._narrowed(lasts[0], window, size - 1)
        key = (window[cut:], tuple(kept))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append((*key, tuple(i - cut for i in still)))
        move = self.moves[state << 8 | byte] = (to, self.emits.setdefault(emitted, emitted))
        return move

    def _finish(self, state: int) -> tuple[int, ...]:
        window, lasts, _ = self.states[state]
        at, tokens = len(window), []
        while at:
            tokens.append(self.ranks[lasts[at]])
            at -= len(lasts[at])
        done = self.ends[state] = tuple(reversed(tokens))
        return done

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece, in time proportional to its length."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.moves) > self.limit:
            self._restart()
        state, ids, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
                if len(moves) > 2 * self.limit:  # one endless piece: begin a new table at the state it gets into
                    own = self.states[move[0]]
                    self._restart()
                    moves = self.moves
                    number = self.number.setdefault(own[:2], 1)
                    self.states += [own] * number
                    move = (number, move[1])
            state, emitted = move
            if emitted:
                ids += emitted
        done = self.ends.get(state)
        ids += self._finish(state) if done is None else done
        return tuple(ids)


class Encoder(dict):
    """Texts to token ids; as a dict, a bounded cache of the pieces met (piece -> ids).

    When it is full it becomes the old generation, from which pieces still in use come back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, moves: int = TABLE_LIMIT, pieces: int = PIECE_LIMIT):
        self.transducer, self.limit = BpeTransducer(ranks, moves), pieces
        self.pieces = regex.compile(pattern).findall
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
            if len(piece) > 64:  # long pieces rarely return
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))


def _utf8_length(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0


def _utf8_continues(pending: bytes, byte: int) -> bool:
    """Whether ``byte`` may follow an unfinished sequence (no overlong forms, surrogates or values over U+10FFFF)."""
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(pending[0], low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(pending[0], high)
    return low <= byte <= high


def utf8_step(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """The byte-level automaton: text completed by ``data`` after ``pending``, and the unfinished sequence left."""
    out: list[str] = []
    for byte in data:
        if pending:
            if _utf8_continues(pending, byte):
                pending += bytes((byte,))
                if len(pending) == _utf8_length(pending[0]):
                    out.append(pending.decode("utf-8"))
                    pending = b""
                continue
            out.append("�")
            pending = b""
        size = _utf8_length(byte)
        if size == 1:
            out.append(chr(byte))
        elif size:
            pending = bytes((byte,))
        else:
            out.append("�")
    return "".join(out), pending


def unfinished(data: bytes) -> int:
    """How many bytes at the end are the beginning of a character that may still be completed."""
    for size in range(1, min(3, len(data)) + 1):
        tail = data[-size:]
        if not _utf8_continues(b"", tail[0]):  # no continuation byte: a character begins here or nowhere
            begun = _utf8_length(tail[0]) > size and all(_utf8_continues(tail[:i], tail[i]) for i in range(1, size))
            return size if begun else 0
    return 0


class Decoder:
    """Streaming decoder: ``feed`` ids as they come, ``close`` at the end.

    Its state is the unfinished character (three bytes at most).  What is well-formed up to there is decoded as a whole;
    only where it isn't does the automaton go byte by byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        try:
            data = self.pending + b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"id outside the vocabulary: {e.args[0]}") from None
        left = unfinished(data)
        try:
            text, self.pending = data[: len(data) - left].decode("utf-8"), data[len(data) - left :]
        except UnicodeDecodeError:
            text, self.pending = utf8_step(b"", data)
        return text

    def close(self) -> str:
        left, self.pending = self.pending, b""
        return "�" if left else ""

    def decode(self, ids: Iterable[int]) -> str:
        self.pending = b""
        return self.feed(ids) + self.close()


#: Rows that are handled at a time, so that memory follows one slice and not Spark's whole Arrow batch.
SLICE = 128


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _with(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, moves: int = TABLE_LIMIT, pieces: int = PIECE_LIMIT) -> DataFrame:
    """``docs`` with the ids of ``text_col`` as array<int> in ``ids_col``; narrow, no shuffle.

    With ``decoded_col`` the ids are decoded again in the same pass, as ``decode`` would, by workers that hold both tables.
    ``moves`` and ``pieces`` bound the tables.
    """
    names = column_names(docs, ids_col, *([decoded_col] if decoded_col else []))
    at = docs.columns.index(text_col)

    def make() -> tuple[Encoder, Decoder]:
        ranks = read_ranks(ranks_path)
        return Encoder(ranks, pattern, moves, pieces), Decoder(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, decoder = worker_tables(("bpe", ranks_path, pattern, moves, pieces), make)
        with no_cycles():
            for batch in _slices(batches):
                offsets, flat, back = [0], [], []
                for text in batch.column(at):
                    ids = encoder.encode(text.as_py() or "")
                    if decoded_col:
                        back.append(decoder.decode(ids))
                    flat.append(np.array(ids, dtype=np.int32))
                    offsets.append(offsets[-1] + len(ids))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))
                done = _with(batch, column, names[0])
                yield _with(done, pa.array(back, pa.string()), names[1]) if decoded_col else done

    added = [T.StructField(names[0], T.ArrayType(T.IntegerType())), *(T.StructField(n, T.StringType()) for n in names[1:])]
    return docs.transform(in_arrow, run, T.StructType([*docs.schema.fields, *added]), keeps=True)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``ids_col``, as the streaming decoder gives it; narrow, no shuffle."""
    (name,) = column_names(docs, text_col)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_tables(("bpe-decode", ranks_path), lambda: Decoder(read_ranks(ranks_path)))
        for batch in _slices(batches):
            texts = [coder.decode(ids.values.to_pylist() if ids.is_valid else ()) for ids in batch.column(at)]
            yield _with(batch, pa.array(texts, pa.string()), name)

    return docs.transform(in_arrow, run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]), keeps=True)
