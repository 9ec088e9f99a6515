"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 machine.

Encoding. Every prefix of a piece has exactly one merge result, and a token sequence is a merge
result iff each two neighbours are (their joined bytes merge to just those two tokens). A
nondeterministic transducer therefore guesses token ends and checks neighbours. It is determinised
lazily: a state is the set of live hypotheses, each the bytes of the token being read and what may
complete it. Tokens are emitted as soon as one hypothesis is left, so lookahead is bounded by the
overlap of vocabulary entries. The table of states is bounded too: when it is full it is
cleared, and states are made anew as they are met.

Decoding. A machine over UTF-8's lead and continuation bytes carries the unfinished character from
token to token; its steps over whole tokens are memoised, so text comes out as tokens come in.

Defined results: null text counts as empty (no tokens; both digests are those of the empty string).
Null ids are kept. Very long texts are encoded whole, match by match. Repeated rows give repeated results. Other columns, whatever their names, are
not read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import spread

#: Bounds of the per-worker memories; they are cleared when full, which changes speed alone.
MAX_STATES = 150_000
MAX_PIECES = 500_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: one ``base64 rank`` pair on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge_encode(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The merge procedure itself; it decides which neighbours are valid."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[x] for x in parts)


class Transducer:
    """Maps the bytes of one piece to token ids.

    A hypothesis is (bytes of the token being read, tokens that may still complete it after the
    token before it). Where very many could, the token before it stands in for them. Each step
    gives the one token that ends at this byte; tokens come out once a state has a single
    hypothesis, or at the piece's end, by following token lengths back over that short window.
    """

    FEW = 24

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.under: dict[bytes, list[int]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                self.under.setdefault(token[:i], []).append(rank)
        self.max_states = max_states
        self.valid: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict] = []
        self._number(((b"", -1),))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def neighbours(self, a: int, b: int) -> bool:
        """Whether tokens a, b may stand side by side; -1 is the piece's start."""
        if a < 0:
            return True
        found = self.valid.get((a, b))
        if found is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            found = self.valid[a, b] = merge_encode(self.tokens[a] + self.tokens[b], self.ranks) == (a, b)
        return found

    def _grow(self, number: int, byte: int) -> tuple[int, int, bool]:
        """Makes a step: the next state's number, the token ending here, and whether all else is settled."""
        live, done = [], []
        for part, after in self.states[number]:
            part += bytes((byte,))
            if type(after) is tuple:
                left = tuple(t for t in after if self.tokens[t].startswith(part))
                token = next((t for t in left if self.lengths[t] == len(part)), None)
                left = tuple(t for t in left if t != token)
            else:
                token = self.ranks.get(part)
                token = token if token is not None and self.neighbours(after, token) else None
                left = self.under.get(part, ())
                left = tuple(t for t in left if self.neighbours(after, t)) if len(left) <= self.FEW else after
            if token is not None:
                done.append(token)
            if left != ():
                live.append((part, left))
        if len(done) != 1:
            raise LookupError("no single merge result")
        live.append((b"", done[0]))
        step = self._number(tuple(live)), done[0], len(live) == 1
        self.steps[number][byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece, as the merge procedure gives them."""
        if len(self.states) > self.max_states:
            self._clear()
        steps, at, out, ended = self.steps, 0, [], []
        try:
            for byte in piece:
                try:
                    at, token, settled = steps[at][byte]
                except KeyError:
                    at, token, settled = self._grow(at, byte)
                ended.append(token)
                if settled:
                    self._emit(ended, out)
        except LookupError:  # a vocabulary whose merges are not closed
            return list(merge_encode(piece, self.ranks))
        self._emit(ended, out)
        return out

    def _emit(self, ended: list[int], out: list[int]) -> None:
        """Moves the settled window's tokens to ``out``."""
        at, lengths, found = len(ended), self.lengths, []
        while at:
            token = ended[at - 1]
            found.append(token)
            at -= lengths[token]
        out += found[::-1]
        ended.clear()


def latin_splitter(pattern: str):
    """The pattern's ``findall`` for texts of the first 256 characters alone, or None.

    There, classes are short lists, which the standard library's matcher runs through twice as fast.
    """
    members = lambda name: "".join(f"\\x{i:02x}" for i in range(256) if regex.fullmatch(name, chr(i)))
    classes = {name: members(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((x for x in (*classes, r"\S") if pattern.startswith(x, at)), None)
        if name == r"\S" and not inside:
            out.append(f"[^{classes[r'\s']}]")
        elif name in classes:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        elif pattern[at] == "\\":
            return None
        else:
            name = pattern[at]
            inside = name == "[" or (inside and name != "]")
            out.append(name)
        at += len(name)
    return re.compile("".join(out)).findall


class Encoder(dict):
    """Pieces to id lists; a whole piece that is a token stays one token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.split_latin = latin_splitter(pattern)

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.transducer.ranks.get(raw)
        ids = [whole] if whole is not None else self.transducer.encode(raw)
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        split = self.split_latin
        if split and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                split = None
        for piece in (split or self.split)(text):
            out += self[piece]
        return out


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    """One byte through the UTF-8 machine: what is still pending, and the characters that are done.

    A malformed sequence gives U+FFFD and the byte that broke it is read again.
    """
    if not pending:
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes((byte,)), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")
    lead, n = pending[0], len(pending)
    low, high = 0x80, 0xBF
    if n == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    if not low <= byte <= high:
        rest, text = utf8_step(b"", byte)
        return rest, "�" + text
    pending += bytes((byte,))
    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return (b"", pending.decode()) if n + 1 == need else (pending, "")


class Decoder:
    """Ids to text, piece by piece; :meth:`feed` may be called with any cut of the ids."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.memo: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.pending = b""

    def _step(self, pending: bytes, token: int) -> tuple[bytes, str]:
        rest, text = pending, []
        for byte in self.tokens[token]:
            rest, done = utf8_step(rest, byte)
            text.append(done)
        step = self.memo.setdefault(pending, {})[token] = rest, "".join(text)
        self.memo.setdefault(rest, {})
        return step

    def feed(self, ids: Iterable[int]) -> str:
        pending, memo, out = self.pending, self.memo, []
        for token in ids:
            try:
                pending, text = memo[pending][token]
            except KeyError:
                pending, text = self._step(pending, token)
            out.append(text)
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        """The end of the stream: an unfinished character is one U+FFFD."""
        rest, self.pending = self.pending, b""
        return "�" if rest else ""


_made: dict[tuple[str, str], tuple[Encoder, Decoder, list[str]]] = {}


def machines(path: str, pattern: str) -> tuple[Encoder, Decoder, list[str]]:
    """The worker's encoder and decoder; they live as long as the worker."""
    if (path, pattern) not in _made:
        ranks = load_ranks(path)
        tokens = {rank: token for token, rank in ranks.items()}
        _made[path, pattern] = Encoder(ranks, pattern), Decoder(tokens), [str(i) for i in range(max(tokens) + 1)]
    return _made[path, pattern]


def roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, one row for each row of ``docs``.

    The text passes once through Python by Arrow; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, names = machines(path, pattern)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                decoded = decoder.feed(ids) + decoder.finish()
                text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, SCHEMA)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` under the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
