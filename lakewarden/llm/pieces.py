"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised (spaces become U+2581, one is put in front) and cut into chunks where
no piece of the vocabulary can span: before a U+2581 that follows another character, and around
line breaks. Each chunk is merged by an agenda of adjacent symbol pairs, best score
first, leftmost at ties; the agendas of all new chunks of one length advance side by side in
numpy. Symbols outside the vocabulary become byte pieces. Ids of chunks are kept in a
bounded table of the worker. Chunks that a batch merges for the first time
are encoded by the sentencepiece library in one call and must agree; decoded texts must
equal the text they came from, or else what the library decodes.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, joined_columns

SPACE = "▁"
#: Chunks whose ids a worker keeps between batches (about 200 bytes each).
CACHE_CHUNKS = 500_000
#: Characters of a text, and chunks of several, that are taken at once.
TEXT_CHARS, HELD_CHUNKS = 1 << 20, 500_000
#: Chunks over this length are merged one by one.
LONG_CHUNK = 48
#: Chunks of one call to the library.
COMPARED = 500
_NEVER = np.iinfo(np.int32).max
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class PieceCoder:
    """Encoder and decoder over a merge-type model; ``check`` compares with the library."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        size = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in normal}
        self.scores = {names[i]: lib.get_score(i) for i in normal}
        if len(self.byte_ids) != 256 or any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("needs byte pieces, and pieces with spaces only in front and no line break")
        spoken = [p.replace(SPACE, " ").encode() for p in names]
        for i in range(size):
            if lib.is_control(i):
                spoken[i] = b""
            elif lib.is_unknown(i):
                spoken[i] = lib.decode([i]).encode()
        for b, i in self.byte_ids.items():
            spoken[i] = bytes([b])
        self.spoken, self.own_start = spoken, [lib.is_byte(i) or lib.is_unknown(i) for i in range(size)]
        #: Pairs of characters that stand side by side in some piece.
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.line_break = array("i", [self.byte_ids[10]]).tobytes()
        self.known: dict[str, bytes] = {"\n": self.line_break, "": b""}
        #: Symbols of all characters.
        self.of_point = np.arange(0x110000, dtype=np.int64) + size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self._table()

    def _table(self) -> None:
        """Mergeable pairs as sorted keys, with the merged symbol and the rank of its score."""
        ranks = {v: k for k, v in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, i, ranks[self.scores[piece]]))
        rows.sort()
        keys, merged, rank = zip(*rows)
        # one more entry, found by no pair, with the rank of no agenda
        self.pair_keys = np.array([*keys, (1 << 63) - 1], np.int64)
        self.pair_symbol, self.pair_rank = np.array([*merged, 0], np.int64), np.array([*rank, _NEVER], np.int32)

    def _symbol(self, part: str) -> int | None:
        """Number of a symbol: a piece's id, or for another character one past all ids."""
        found = self.ids.get(part)
        return len(self.spoken) + ord(part) if found is None and len(part) == 1 else found

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        at[self.pair_keys[at] != keys] = -1
        return self.pair_symbol[at], self.pair_rank[at]

    def _agendas(self, symbols: np.ndarray):
        """Merge rows of equal length side by side; yields (rows, what is left of them).

        A row's agenda is the ranks of its adjacent pairs; every turn each row pops its
        best entry, leftmost at ties, so all rows that go on lose one symbol a turn.
        """
        rows = np.arange(len(symbols))
        merged, rank = self._look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            if width == 1:
                yield rows, symbols
                return
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), best] != _NEVER
            if not going.all():
                yield rows[~going], symbols[~going]
                rows, symbols, merged, rank, best = rows[going], symbols[going], merged[going], rank[going], best[going]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            symbols[each, best] = merged[each, best]
            symbols = symbols[np.arange(width) != best[:, None] + 1].reshape(len(rows), width - 1)
            keep = np.arange(width - 1) != best[:, None]
            merged, rank = merged[keep].reshape(len(rows), -1), rank[keep].reshape(len(rows), -1)
            for there, pair in ((best > 0, best - 1), (best < width - 2, best)):
                r, k = each[there], pair[there]
                if len(r):
                    merged[r, k], rank[r, k] = self._look_up(symbols[r, k], symbols[r, k + 1])

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same agenda as a heap, for one long chunk."""
        n = len(symbols)
        live = [True] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stamp = [0] * n
        merged, rank = self._look_up(np.array(symbols[:-1]), np.array(symbols[1:]))
        agenda = [(int(r), k, k + 1, int(m), 0, 0) for k, (m, r) in enumerate(zip(merged, rank)) if r != _NEVER]
        heapify(agenda)
        while agenda:
            _, a, b, symbol, sa, sb = heappop(agenda)
            if not (live[a] and live[b]) or (stamp[a], stamp[b]) != (sa, sb):
                continue
            symbols[a], live[b] = symbol, False
            stamp[a] += 1
            after[a] = c = after[b]
            if c < n:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < n:
                    m, r = self._look_up(np.array([symbols[x]]), np.array([symbols[y]]))
                    if r[0] != _NEVER:
                        heappush(agenda, (int(r[0]), x, y, int(m[0]), stamp[x], stamp[y]))
        return [s for s, on in zip(symbols, live) if on]

    def _ids(self, symbols: list[int]) -> bytes:
        size, out = len(self.spoken), []
        for s in symbols:
            out.extend([s] if s < size else [self.byte_ids[x] for x in chr(s - size).encode()])
        return array("i", out).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks into the table; a last mark that no piece joins is cut off."""
        known = self.known
        cut = {c for c in chunks if len(c) > 2 and c[-2:] not in self.inside}
        plain = {c for c in chunks if c not in cut} | {x for c in cut for x in (c[:-1], c[-1])}
        by_length: dict[int, list[str]] = {}
        for c in plain:
            if c not in known:
                by_length.setdefault(len(c), []).append(c)
        size = len(self.spoken)
        for length, group in by_length.items():
            points = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
            symbols = self.of_point[points].reshape(len(group), length)
            if length > LONG_CHUNK:
                for c, row in zip(group, symbols):
                    known[c] = self._ids(self._merge_long(row.tolist()))
                continue
            for rows, left in self._agendas(symbols):
                if left.size and int(left.max()) < size:
                    body, wide = left.astype(np.int32).tobytes(), 4 * left.shape[1]
                    for k, r in enumerate(rows.tolist()):
                        known[group[r]] = body[k * wide:(k + 1) * wide]
                else:
                    for r, row in zip(rows.tolist(), left.tolist()):
                        known[group[r]] = self._ids(row)
        if self.check:
            self._compare([c for group in by_length.values() for c in group])
        for c in cut:
            known[c] = known[c[:-1]] + known[c[-1]]

    def _compare(self, chunks: list[str]) -> None:
        """New chunks must have the library's ids; line breaks part them, so one text asks for many."""
        for at in range(0, len(chunks), COMPARED):
            part = chunks[at:at + COMPARED]
            theirs = array("i", self.library.encode("\n" + "\n".join(part))).tobytes()
            if theirs[4:] != b"".join([self.line_break + self.known[c] for c in part]):
                for c in part:
                    theirs = array("i", self.library.encode("\n" + c)[2:]).tobytes()
                    if theirs != self.known[c]:
                        raise RuntimeError(f"chunk {c!r} is encoded otherwise by the library")

    def _chunks(self, text: str):
        """Lists of chunks of a text, each of bounded length."""
        if not text:
            return
        if len(text) <= TEXT_CHARS and text[0] != " " and not ("  " in text or SPACE in text or "\0" in text):
            yield (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0")
            return
        shown, at = SPACE + text.replace(" ", SPACE), 0
        while at < len(shown):
            end = at + TEXT_CHARS
            while end < len(shown) and not (shown[end] == SPACE and shown[end - 1] != SPACE):
                end += 1
            yield _CHUNK.findall(shown[at:end])
            at = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as int32 bytes, as the library's encode() without begin and end ids."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        count = 0

        def settle():
            needed = set().union(*(c for _, c in held))
            missing = needed.difference(self.known)
            if len(self.known) + len(missing) > CACHE_CHUNKS:
                self.known = {"\n": self.line_break, "": b""}
                missing = needed.difference(self.known)
            if missing:
                self.learn(missing)
            for k, chunks in held:
                out[k].append(b"".join(map(self.known.__getitem__, chunks)))
            held.clear()

        for k, text in enumerate(texts):
            for chunks in self._chunks(text):
                held.append((k, chunks))
                count += len(chunks)
                if count > HELD_CHUNKS:
                    settle()
                    count = 0
        if held:
            settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids) -> str:
        """Text of ids, as the library's decode(); broken byte runs become U+FFFD."""
        if not len(ids):
            return ""
        spoken = self.spoken
        body = b"".join([spoken[i] for i in ids])
        try:
            text = body.decode()
        except UnicodeDecodeError:
            return self.library.decode([int(i) for i in ids])
        return text[1:] if text[:1] == " " and not self.own_start[ids[0]] else text


_CODERS: dict[tuple[int, bool], PieceCoder] = {}


def coder(model: bytes, check: bool = True) -> PieceCoder:
    """The worker's coder for a model: one at a time."""
    key = (hash(model), check)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model, check)
    return _CODERS[key]


def _pass(model: bytes, check: bool, names: list[str], text_at: int, with_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(model, check)
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        encoded, decoded = [np.frombuffer(body, np.int32) for body in c.encode_all(texts)], []
        if with_text:
            for text, found in zip(texts, encoded):
                back = c.decode(found.tolist())
                if check and back != text.replace(SPACE, " ") and back != c.library.decode(found.tolist()):
                    raise RuntimeError("a text is decoded otherwise by the library")
                decoded.append(back)
        offsets = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(e) for e in encoded], out=offsets[1:])
        values = pa.array(np.concatenate(encoded) if encoded else np.zeros(0, np.int32))
        if offsets[-1] < 2**31 - 1:
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        else:
            ids = pa.LargeListArray.from_arrays(pa.array(offsets), values)
        cols = [*batch.columns, ids] + ([pa.array(decoded, pa.string())] if with_text else [])
        return pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids: str = "ids", decoded: str | None = "decoded", check: bool = True) -> DataFrame:
    """``docs`` with the token ids of its text and the text decoded from them.

    A null text counts as empty: no ids, and it decodes to the empty text. Other columns pass
    through; new columns get leading underscores if ``docs`` has their names. ``decoded=None``
    leaves decoding out. The model's bytes (half a megabyte) travel with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    names = [*docs.columns]
    names.append(joined_columns(names, ids))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{names[-1]}` array<int>"
    if decoded:
        names.append(joined_columns(names, decoded))
        schema += f", `{names[-1]}` string"
    return arrow_pass(docs, _pass(model, check, names, docs.columns.index(text_col), bool(decoded)), schema)


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = f.read()
    name = joined_columns(rows.columns, decoded)
    at, names = rows.columns.index(ids_col), [*rows.columns, name]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(model)
        texts = [None if x.as_py() is None else c.decode(x.as_py()) for x in batch.column(at)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` string"
    return arrow_pass(rows, run, schema)


def token_digests(rows: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, in place of columns with these names."""
    return rows.withColumns({
        "n_tokens": F.size(ids).cast("bigint"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2(decoded, 256),
    })
