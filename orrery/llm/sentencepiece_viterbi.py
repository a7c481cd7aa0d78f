"""SentencePiece pieces by a streaming Viterbi search, and back to text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import process_cache
from orrery.llm.segments import BLOCK, Codes, gather, groups

MARK = "▁"
#: Scores are whole millionths, so that sums are exact and ties are ties.
UNIT = 1_000_000
#: What a character that no piece has costs beyond the least likely piece, as in the library's own search.
UNKNOWN = 10 * UNIT
_NEVER = -(1 << 62)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, ids and scores of a model file. The best segmentation is the one with the largest sum of the model's own scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.ids = {p: i for i, p in enumerate(self.text) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.score = [round(UNIT * sp.get_score(i)) for i in range(len(self.text))]
        self.unknown = min(self.score[i] for i in self.ids.values()) - UNKNOWN
        self.longest = max(map(len, self.ids))
        #: scores of pieces, and None for other beginnings of pieces; what isn't here ends a search early
        self.table = {p[:n]: None for p in self.ids for n in range(1, len(p) + 1)} | {p: self.score[i] for p, i in self.ids.items()}
        #: no piece goes on past a mark that follows another character, so all paths meet before it
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        #: nor does one with more characters hold a line end
        self.lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        raw = [bytes((self.of_byte[i],)) if i in self.of_byte else t.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, t in enumerate(self.text)]
        self.size = np.array([len(r) for r in raw])
        self.raw, self.first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.size) - self.size
        self.codes = Codes(self._search, "<u4")

    def _search(self, part: bytes) -> list[int]:
        v = Viterbi(self)
        return v.feed(part.decode("utf-8", "surrogatepass").replace(" ", MARK)) + v.finish()

    def spell(self, i: int | None, char: str) -> list[int]:
        """The ids of a piece, or of a character that none has."""
        if i is not None:
            return [i]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [0]


class Viterbi:
    """Best segmentation of characters that arrive in parts. feed() returns the ids that are settled, finish() the rest.

    Kept are the characters and backpointers since the last settled boundary. A boundary's paths are extended by every piece that
    starts there once `longest` characters after it are known, so each boundary is passed once. The paths that survive are the best
    ones to the boundaries not yet passed: when all of them go through one boundary, the ids up to it can't change, are given
    out and forgotten. Of equal scores, the longer last piece wins.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.chars = ""  # since the last settled boundary
        self.best = [0]  # of a path to each boundary
        self.back = [0]  # the boundary before
        self.passed = self.checked = 0

    def feed(self, chars: str) -> list[int]:
        out, step = [], 4 * self.p.longest
        for at in range(0, len(chars), step):
            self._take(chars[at : at + step])
            self._pass(len(self.chars) - self.p.longest + 1)
            if self.passed - self.checked >= step:
                out += self._settle()
        return out

    def finish(self) -> list[int]:
        self._pass(len(self.chars))
        out = self._ids(len(self.chars))
        self.__init__(self.p)
        return out

    def _take(self, chars: str) -> None:
        self.chars += chars
        self.best += [_NEVER] * len(chars)
        self.back += [0] * len(chars)

    def _pass(self, end: int) -> None:
        """Extend the paths of the boundaries before `end`."""
        chars, best, back, get, n = self.chars, self.best, self.back, self.p.table.get, len(self.chars)
        for a in range(self.passed, end):
            base = best[a]
            if base == _NEVER:
                continue
            if get(chars[a]) is None and base + self.p.unknown > best[a + 1]:
                best[a + 1], back[a + 1] = base + self.p.unknown, a
            for b in range(a + 1, n + 1):
                s = get(chars[a:b], 1)
                if s is None:
                    continue
                if s == 1:  # scores are logarithms, never above 0
                    break
                if base + s > best[b]:
                    best[b], back[b] = base + s, a
        self.passed = max(self.passed, end)

    def _walk(self, end: int) -> list[int]:
        at = []
        while end:
            at.append(end)
            end = self.back[end]
        return at

    def _ids(self, end: int) -> list[int]:
        out, a = [], 0
        for b in reversed(self._walk(end)):
            out += self.p.spell(self.p.ids.get(self.chars[a:b]), self.chars[a:b])
            a = b
        return out

    def _settle(self) -> list[int]:
        """Give out up to the last boundary that the paths to all live boundaries share."""
        live = [b for b in range(self.passed, len(self.chars) + 1) if self.best[b] != _NEVER]
        shared = set(self._walk(live[0]))
        for b in live[1:]:
            shared &= set(self._walk(b))
        self.checked = self.passed
        if not shared:
            return []
        cut = max(shared)
        out, base = self._ids(cut), self.best[cut]
        self.chars = self.chars[cut:]
        self.best = [b if b == _NEVER else b - base for b in self.best[cut:]]
        self.back = [max(0, b - cut) for b in self.back[cut:]]
        self.passed, self.checked = self.passed - cut, self.checked - cut
        return out


def encode_many(p: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts: spaces become marks, one is put before. The search settles wherever no piece crosses a mark or a line end:
    texts are cut there, and a part that was searched before has the ids it had."""
    made = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in groups([len(m) for m in made]):
        raw, ends = b"".join(made[lo:hi]), np.cumsum([len(m) for m in made[lo:hi]])
        b, starts = np.frombuffer(raw, np.uint8), np.append(0, ends[:-1])
        begins = np.zeros(len(b), bool)
        if p.apart and len(b):
            begins[1:] = (b[1:] == 32) & (b[:-1] != 32)
            if p.lines:
                begins |= b == 10
                begins[1:] |= b[:-1] == 10
        begins[starts[starts < ends]] = True
        first = np.flatnonzero(begins)
        ids, before = p.codes(raw, first)
        out += [ids[before[i] : before[j]] for i, j in zip(np.searchsorted(first, starts), np.searchsorted(first, ends), strict=True)]
    return out


def encode(p: Pieces, text: str | None) -> list[int]:
    """Ids of a whole text."""
    return encode_many(p, [text or ""])[0].tolist()


def decode_bytes(p: Pieces, ids: np.ndarray) -> bytes:
    """The text of ids in UTF-8: their pieces one after the other, marks as spaces, without the one put before."""
    parts = [gather(p.raw, p.first[x], p.size[x]).tobytes() for x in (ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK))]
    return b"".join(parts)[1:]


def decode(p: Pieces, ids: list[int]) -> str:
    """The text of ids; encode's inverse for texts without the mark itself, which reads back as a space."""
    return decode_bytes(p, np.array(ids, np.int64)).decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>). Null or empty text: no ids. A text that holds the mark itself reads back with spaces there.
    Repeated rows: each its own. Null doc_id: kept. Empty table: no rows. A very long text is held once with its ids. No shuffle;
    other columns are ignored."""
    model = model or default_model()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = process_cache(f"pieces:{model}", lambda: Pieces(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                found = encode_many(p, [t or "" for t in b.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, ids array<int>").withColumnRenamed("doc_id", doc_id)


def digest_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip): encode_documents and decode in one pass, without moving the ids.
    round_trip: the ids read back as the text itself. Odd rows as in encode_documents."""
    model = model or default_model()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = process_cache(f"pieces:{model}", lambda: Pieces(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = encode_many(p, texts)
                back = [decode_bytes(p, x) for x in found]
                cols = [
                    b.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("doc_id", doc_id)
