"""Varied SentencePiece segmentations by seeded merge-dropout, and their lossless decoding.

Encoding works the merge agenda of a BPE vocabulary: again and again the candidate merge of two neighbouring pieces
with the best score, leftmost first, is taken. A keyed hash of the candidate (seed, text, unit's place in the text, and
where the two pieces begin, meet and end in the unit) decides whether it is skipped for good, so each occurrence of a
word is segmented by itself, a text has one segmentation for a seed, and another for the next seed. With a dropout of
0 the result is the model's own.

No piece of such a vocabulary has a blank after another character, so the units are words with the blanks before
them. The agendas of all units of like length of a batch are worked in step as arrays; long units (a text without
blanks) have a heap each. Nothing is remembered from batch to batch.

Characters without a piece become UTF-8 byte pieces (so does U+2581, which stands for the blank in pieces), and so do
bytes that are no UTF-8, hence every text decodes to itself. Defined results. Null and empty text: no pieces. Repeated
rows have the same pieces. An empty table gives an empty result. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk

DROPOUT = 0.1
SEED = 20240229
BLANK = "▁"
#: Units up to this length are worked as arrays.
IN_STEP = 200
_FAR = np.int64(1 << 40)
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """tk.mix of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class Pieces:
    """Pieces and merges of a BPE model of SentencePiece with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        stands_for = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], stands_for[i] = i, bytes([value])
        known = {names[i]: i for i in normal}
        for i in normal:
            stands_for[i] = names[i].replace(BLANK, " ").encode()
        self.blob = np.frombuffer(b"".join(stands_for), np.uint8)
        self.sizes = np.array(list(map(len, stands_for)), np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        # Piece by code point; a character without a piece takes part as the negative of its code point.
        self.of_char = (-2 - np.arange(0x110000)).astype(np.int32)
        for c, i in known.items():
            if len(c) == 1:
                self.of_char[32 if c == BLANK else ord(c)] = i
        self.of_char[ord(BLANK)] = -2 - ord(BLANK)
        if any(BLANK in p.lstrip(BLANK) for p in known):
            raise ValueError("the model has pieces with a blank after another character")
        order = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        merges = [(known[p[:k]] * n + known[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        merges.sort()
        self.n = n
        self.keys = np.array([m[0] for m in merges], np.int64)
        self.merged = np.array([m[1] for m in merges], np.int32)
        self.rank = np.array([order[m[1]] for m in merges], np.int64)
        self._table: dict[int, tuple[int, int]] = {}

    def candidates(self, left: np.ndarray, right: np.ndarray, name: np.ndarray, begin: np.ndarray, meet: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of neighbours; skipped ones, and those without a merge, have a rank beyond all others."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = np.flatnonzero((self.keys[at] == key) & (left >= 0) & (right >= 0))
        if limit and len(fits):
            place = (begin[fits].astype(np.uint64) << np.uint64(42)) ^ (meet[fits].astype(np.uint64) << np.uint64(21)) ^ end[fits].astype(np.uint64)
            fits = fits[(tk.mix(name[fits] ^ tk.mix(place)) >> np.uint64(32)) >= np.uint64(limit)]
        rank, to = np.full(len(key), _FAR), np.zeros(len(key), np.int32)
        rank[fits], to[fits] = self.rank[at[fits]], self.merged[at[fits]]
        return rank, to

    def segment(self, ids: np.ndarray, lengths: np.ndarray, name: np.ndarray, limit: int) -> None:
        """Works the agendas of units (rows of ids, of the given lengths): a piece is left where its first character was, -1 elsewhere."""
        n, width = ids.shape
        column = np.arange(width)
        last = np.minimum(column + 1, lengths[:, None])  # where the next piece begins, or the unit's length
        following = np.concatenate([last, lengths[:, None]], axis=1)
        before = np.repeat(np.arange(-1, width)[None, :], n, axis=0)
        rank, to = np.full((n, width), _FAR), np.zeros((n, width), np.int32)
        i, j = np.nonzero(column + 1 < lengths[:, None])
        if len(i):
            rank[i, j], to[i, j] = self.candidates(ids[i, j], ids[i, j + 1], name[i], j, j + 1, following[i, j + 1], limit)
        live = np.arange(n)
        while len(live):
            ranks = rank[live]
            k = ranks.argmin(axis=1)
            goes = ranks[np.arange(len(live)), k] < _FAR
            live, k = live[goes], k[goes]
            if not len(live):
                break
            meet = following[live, k]
            end = following[live, meet]
            ids[live, k] = to[live, k]
            ids[live, meet], rank[live, meet] = -1, _FAR
            following[live, k] = end
            before[live, end] = k
            first = before[live, k]
            has_first, has_next = np.flatnonzero(first >= 0), np.flatnonzero(end < lengths[live])
            rank[live, k] = _FAR
            row = np.concatenate([live[has_first], live[has_next]])
            if not len(row):
                continue
            begin, middle = np.concatenate([first[has_first], k[has_next]]), np.concatenate([k[has_first], end[has_next]])
            stop = np.concatenate([end[has_first], following[live[has_next], end[has_next]]])
            rank[row, begin], to[row, begin] = self.candidates(ids[row, begin], ids[row, middle], name[row], begin, middle, stop, limit)

    def segment_long(self, ids: np.ndarray, name: int, limit: int) -> None:
        """The same for one unit, with a heap."""
        if not self._table:
            self._table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        own, n = ids.tolist(), len(ids)
        following, before, agenda = list(range(1, n + 1)), list(range(-1, n)), []

        def push(k: int) -> None:
            meet = following[k]
            if meet < n and own[k] >= 0 and own[meet] >= 0 and (found := self._table.get(own[k] * self.n + own[meet])):
                end = following[meet]
                if not limit or _mix(name ^ _mix((k << 42 ^ meet << 21 ^ end) & _MASK)) >> 32 >= limit:
                    heapq.heappush(agenda, (found[0], k, meet, end, found[1]))

        for k in range(n):
            push(k)
        while agenda:
            _, k, meet, end, to = heapq.heappop(agenda)
            # Gone if one of the two pieces has been merged since.
            if own[k] == -1 or following[k] != meet or following[meet] != end or own[meet] == -1:
                continue
            own[k], own[meet], following[k] = to, -1, end
            if end < n:
                before[end] = k
            if before[k] >= 0:
                push(before[k])
            push(k)
        ids[:] = own

    def encode(self, texts: list[str], names: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids; names: 64-bit keys of the texts."""
        # The model puts a blank before a text; an empty one has no pieces.
        codes = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        stops = np.cumsum(sizes)
        out, blank = self.of_char[codes], codes == 32
        # A unit begins with a text, and at blanks after another character.
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        heads = (stops - sizes)[sizes > 0]
        begins[heads] = True
        start = np.flatnonzero(begins)
        lengths = np.diff(np.append(start, len(out)))
        text_of = np.searchsorted(stops, start, side="right")
        first = np.searchsorted(start, heads)
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        name, limit = tk.mix(names[text_of] + place.astype(np.uint64)), int(dropout * (1 << 32))
        order = np.argsort(lengths, kind="stable")
        sorted_lengths, k = lengths[order], 0
        while k < len(order):
            # Units of one length, or of up to a quarter more, and some 400,000 characters at a time.
            shortest = int(sorted_lengths[k])
            if shortest > IN_STEP:
                for u in order[k:].tolist():
                    self.segment_long(out[start[u] : start[u] + lengths[u]], int(name[u]), limit)
                break
            until = int(np.searchsorted(sorted_lengths, min(shortest + shortest // 4, IN_STEP), side="right"))
            rows = order[k : min(until, k + max(1, 400_000 // (shortest + shortest // 4)))]
            k += len(rows)
            width = int(lengths[rows[-1]])
            if width > 1:
                inside = np.arange(width) < lengths[rows][:, None]
                at = np.minimum(start[rows][:, None] + np.arange(width), len(out) - 1)
                ids = np.where(inside, out[at], np.int32(-1))
                self.segment(ids, lengths[rows], name[rows], limit)
                out[at[inside]] = ids[inside]
        total = np.concatenate([[0], np.cumsum(np.where(out == -1, 0, 1))])
        counts = total[stops] - total[stops - sizes]
        whole = out[out != -1]
        odd = np.flatnonzero(whole < 0)
        if len(odd):
            whole, counts = self._with_bytes(whole, counts, odd)
        return whole, counts

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for characters without a piece; U+DC80 to U+DCFF stand for bytes that are no UTF-8."""
        code = -2 - ids[odd].astype(np.int64)
        raw = (code >= 0xDC80) & (code <= 0xDCFF)
        length = np.where(raw, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        data = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape"), np.uint8)
        size = np.ones(len(ids), np.int64)
        size[odd] = length
        ends, stops = np.cumsum(size), np.cumsum(counts)
        out = np.repeat(ids, size)
        at = np.repeat(ends[odd] - length, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[at] = self.byte_ids[data]
        total = np.concatenate([[0], ends])
        return out, total[stops] - total[stops - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from the ids of all one after another."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        ends = np.cumsum(size)
        data = self.blob[np.repeat(self.places[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        # Without the blank before a text.
        return [data[a + 1 : b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """Kept by the Python worker from task to task."""
    return Pieces(path)


def text_names(texts: list[bytes], seed: int) -> np.ndarray:
    """Keys of texts for a seed."""
    crc = np.fromiter(map(zlib.crc32, texts), np.uint64, len(texts))
    return tk.mix(crc ^ np.uint64(tk.mix_int(seed)))


def _encode(path: str, dropout: float, seed: int):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text"), 1_000_000):
                data = data.tobytes()
                raw = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids, n = model.encode([r.decode("utf-8", "surrogateescape") for r in raw], text_names(raw, seed), dropout)
                same = [x == y for x, y in zip(model.decode(ids, n), raw, strict=True)]
                whole, stop = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.cumsum(n)
                sums = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), tk.list_array(ids, n, pa.int32()), pa.array(n), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_pieces", "ids_crc32", "lossless"])

    return run


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """For each row: doc_id, ids, n_pieces, ids_crc32, and whether the ids decode to the text (lossless)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encode(path, dropout, seed), "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """For each row: doc_id and the text that ids stand for."""

    def run(batches):
        model = pieces(path)
        for batch in batches:
            ids, offsets = tk.list_parts(batch.column("ids"))
            texts = model.decode(ids, np.diff(offsets))
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
