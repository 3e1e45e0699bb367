"""SentencePiece BPE encoding by a prefix table, and decoding.

For merge-type vocabularies the encoding of each prefix of a text ends in one
token that no later text changes in that prefix.  The table stores it: an
Aho-Corasick automaton gives the pieces that end at a place; the right one is the
piece that its predecessor, the last token of the prefix before it, may stand
next to, because encoding the two together gives the two again.  Ids are then
read backwards from the end.  The work is linear in the text.

A text is cut where no piece of the vocabulary spans the cut, so a run of such a
part needs encoding once; a bounded table in each Python worker remembers short
ones.  Characters that no piece has become their UTF-8 bytes' pieces.

A null text counts as empty; an empty text has only the end id and decodes to
the empty string.  Repeated rows are coded alike; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from chronicle.llm.shared import documents, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts that a worker remembers, and the longest part that it remembers.
MEMO_PARTS, MEMO_LENGTH = 300_000, 64
#: Texts whose parts are encoded together.
DIGEST_TEXTS = 500


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceCodec:
    """Encoder and decoder of a merge-type model with byte fallback."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.eos = sp.eos_id()
        self.byte_ids = {}
        pieces: dict[str, int] = {}
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                pieces[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.rank = {i: -sp.get_score(i) for i in pieces.values()}
        self.pieces, self.text = pieces, {i: p for p, i in pieces.items()}
        self.split_cache: dict[int, tuple[int, int] | None] = {}
        self.pair_cache: dict[int, bool] = {}
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            if self._tree(i) is not False:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.many = _ManyParts(self)
        self.digits = [str(i) for i in range(sp.get_piece_size())]
        # A text may be cut before a space mark wherever no piece has one after another character.
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.plain = not inner
        self.part = re.compile(".+" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)

    def _tree(self, token: int):
        """The two tokens whose merge is ``token``, None for one character, False if no merge reaches it."""
        if token in self.split_cache:
            return self.split_cache[token]
        piece = self.text[token]
        found: tuple[int, int] | None | bool = None
        if len(piece) > 1:
            parts = self._merge(piece)
            found = parts if parts is not None else False
        self.split_cache[token] = found
        return found

    def _merge(self, piece: str):
        """Merge a vocabulary piece from its characters; the last merge's two sides, if it ends whole."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best[0]):
                    best = (self.rank[i], k)
            if best is None:
                return None
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.pieces[last[0]], self.pieces[last[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two pieces' text together gives these two again.

        Walks down the facing sides of both merge trees in the order in which the
        merges took place; a merge across the border that would have come first
        says no.
        """
        a, b, limit = left, right, float("inf")
        good = True
        while True:
            across = self.pieces.get(self.text[a] + self.text[b])
            if across is not None and self.rank[across] < limit:
                good = False
                break
            # Undo whichever of the two facing tokens was merged last.  Equal ranks: the left merge came first.
            rank_a = self.rank[a] if self._tree(a) else -1.0
            rank_b = self.rank[b] if self._tree(b) else -1.0
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                limit, a = rank_a, self._tree(a)[1]
                # A merge across of equal rank lies to the right of the left one and came later.
            else:
                limit, b = rank_b, self._tree(b)[0]
                limit += 0.5  # ... and to the left of the right one, so it came first.
        if len(self.pair_cache) > 2_000_000:
            self.pair_cache.clear()
        self.pair_cache[left << 32 | right] = good
        return good

    def encode_part(self, part: str) -> list[int]:
        n = len(part)
        last = [-1] * (n + 1)  # the last token of each prefix; -1 stands for a character without a piece
        known = self.pair_cache
        for end, (size, token) in self.automaton.iter(part):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            before = last[start]
            if start and before >= 0:
                fits = known.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end + 1] = token
        text = self.text
        ids: list[int] = []
        while n:
            token = last[n]
            if token == -1:
                ids += [self.byte_ids[x] for x in reversed(part[n - 1].encode())]
                n -= 1
            else:
                ids.append(token)
                n -= len(text[token])
        ids.reverse()
        return ids

    def _record(self, ids: list[int]) -> tuple[str, int, bytes]:
        digits, surface = self.digits, self.surface
        return " ".join([digits[i] for i in ids]), len(ids), b"".join([surface[i] for i in ids])

    def _keys(self, text: str) -> list[str]:
        """The parts of a text, each without its leading space mark."""
        if not text:
            return []
        if self.plain and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in self.parts(text)]

    def _coded(self, keys: list[list[str]]) -> dict[str, tuple[str, int, bytes]]:
        """All parts of some texts with their codes: short ones stay in the memo, long ones only as long as these texts."""
        if len(self.memo) >= MEMO_PARTS:
            self.memo.clear()
        memo, coded = self.memo, {}
        parts = set().union(*keys)
        new = [k for k in parts if k not in memo]
        for k, ids in zip(new, self.many.encode([SPACE + k for k in new]), strict=True):
            (memo if len(k) <= MEMO_LENGTH else coded)[k] = self._record(ids)
        coded.update((k, memo[k]) for k in parts if k not in coded)
        return coded

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, and the SHA-256 of the ids and of the decoded text."""
        sha = lambda x: hashlib.sha256(x).hexdigest()
        end = self.digits[self.eos]
        for first in range(0, len(texts), DIGEST_TEXTS):
            keys = [self._keys(t) for t in texts[first : first + DIGEST_TEXTS]]
            known = self._coded(keys)
            for own in keys:
                coded = [known[k] for k in own]
                ids = " ".join([*[c[0] for c in coded], end])
                back = self._decoded(b"".join([c[2] for c in coded]))
                yield ids.count(" ") + 1, sha(ids.encode()), sha(back.encode())

    def parts(self, text: str) -> list[str]:
        return self.part.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.encode_part(part)] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        return self._decoded(b"".join([self.surface[i] for i in ids]))

    @staticmethod
    def _decoded(raw: bytes) -> str:
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _ManyParts:
    """The prefix tables of many parts at once, a character of each in turn.

    The same automaton as a table of states over the small alphabet of Latin
    pieces; a part with any other character is encoded by itself.
    """

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        letters = sorted({p for p in codec.pieces if len(p) == 1 and (ord(p) < 0x180 or p == SPACE)})
        self.letter = np.zeros(0x2600, dtype=np.int16) - 1
        self.letter[[ord(x) for x in letters]] = np.arange(len(letters))
        usable = set(letters)
        children: list[dict[int, int]] = [{}]
        token = [-1]
        depth = [0]
        for piece, i in sorted(codec.pieces.items()):
            if not usable.issuperset(piece) or codec._tree(i) is False:
                continue
            at = 0
            for c in self.letter[[ord(x) for x in piece]].tolist():
                to = children[at].get(c)
                if to is None:
                    to = children[at][c] = len(children)
                    children.append({})
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            token[at] = i
        self.token = np.array(token, dtype=np.int32)
        self.size = np.zeros(len(codec.surface), dtype=np.int64)
        self.size[list(codec.text)] = [len(p) for p in codec.text.values()]
        n = len(children)
        self.go = np.zeros((n, len(letters)), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int32)
        self.other = np.full(n, -1, dtype=np.int32)  # the longest proper suffix state that is a piece
        for state in sorted(range(n), key=depth.__getitem__):
            if state:
                back = fail[state]
                self.go[state] = self.go[back]
                self.other[state] = back if token[back] >= 0 else self.other[back]
            for c, to in children[state].items():
                fail[to] = self.go[state, c] if state else 0
                self.go[state, c] = to
        # Known pairs: an open hash table of (pair, answer).
        self.slots = 1 << 21
        self.pair = np.full(self.slots, -1, dtype=np.int64)
        self.fits = np.zeros(self.slots, dtype=bool)
        self.filled = 0

    def _slot(self, left, right):
        return ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 11) & (self.slots - 1)

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = self._slot(left.astype(np.int64), right.astype(np.int64))
        while True:
            held = self.pair[at]
            moved = (held != pair) & (held >= 0)
            if not moved.any():
                break
            at = np.where(moved, (at + 1) & (self.slots - 1), at)
        if (held < 0).any():
            for p in np.unique(pair[held < 0]).tolist():
                k = self._slot(p >> 32, p & 0xFFFFFFFF)
                while self.pair[k] >= 0:
                    k = (k + 1) & (self.slots - 1)
                self.pair[k], self.fits[k] = p, self.codec.compatible(p >> 32, p & 0xFFFFFFFF)
                self.filled += 1
            answer = self._compatible(left, right)
            if self.filled > self.slots // 2:
                self.pair[:], self.filled = -1, 0
            return answer
        return self.fits[at]

    def encode(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(parts)
        if not parts:
            return out
        length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(length)])
        letter = np.where(codes < 0x2600, self.letter[np.minimum(codes, 0x25FF)], -1)
        odd = np.zeros(len(parts), dtype=bool)
        odd[np.repeat(np.arange(len(parts)), length)[letter < 0]] = True
        odd |= length > MEMO_LENGTH
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.codec.encode_part(parts[k])
        rows = np.flatnonzero(~odd)
        rows = rows[np.argsort(-length[rows], kind="stable")]
        if not len(rows):
            return out
        longest, first, size = int(length[rows[0]]), starts[rows], length[rows]
        last = np.full((longest + 1, len(rows)), -1, dtype=np.int32)
        state = np.zeros(len(rows), dtype=np.int32)
        for t in range(longest):
            n = int(np.searchsorted(-size, -t, side="left"))  # parts longer than t
            state = self.go[state[:n], letter[first[:n] + t]]
            open_ = np.arange(n)
            at = np.where(self.token[state] >= 0, state, self.other[state])
            while len(open_):
                token = self.token[at]
                start = t + 1 - self.size[token]
                before = last[start, open_]
                good = start == 0
                ask = np.flatnonzero(~good)
                good[ask] = self._compatible(before[ask], token[ask])
                last[t + 1, open_[good]] = token[good]
                open_, at = open_[~good], self.other[at[~good]]
        steps, end, live = [], size.copy(), np.arange(len(rows))
        count = np.zeros(len(rows), dtype=np.int64)
        while len(live):
            token = last[end[live], live]
            steps.append((live, token))
            count[live] += 1
            end[live] -= self.size[token]
            live = live[end[live] > 0]
        place = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(place[-1], dtype=np.int32)
        for back, (live, token) in enumerate(steps):
            flat[place[live + 1] - 1 - back] = token
        ids = flat.tolist()
        for k, a, b in zip(rows.tolist(), place[:-1].tolist(), place[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    model = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            rows = list(coder.digests([t or "" for t in batch.column("text").to_pylist()]))
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each row: the ids themselves, for training."""
    model = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
