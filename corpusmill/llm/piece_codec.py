"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A batch of texts is one flat array of symbols, cut where no vocabulary piece
spans two neighbouring characters: merges never cross such a cut.  Equal parts
are encoded once.  In each round every part finds its best-scored pair of
neighbours (a segmented minimum), all its occurrences merge at once from the
left, and the arrays are compacted, until no pair remains.  Where a piece that
extends the merged one scores as well or better, only the leftmost occurrence
merges in that round, so the order is always that of one merge at a time; a
part with many such occurrences is finished pair by pair from a queue, so long
unbroken runs take little more than linear time.

Edge cases: a null text is an empty one (begin and end ids only); characters
outside the vocabulary become byte pieces; repeated rows give repeated rows;
columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ._batches import ddl, map_documents, with_id

BLANK = "▁"  # stands for a blank in the vocabulary
UNKNOWN = " ⁇ "  # how the unknown piece reads
CODES = 0x110000
NONE = np.int64(2**62)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
QUEUED = 64  # occurrences of which only the leftmost may merge, from which on a part goes pair by pair
PROBES = ("", "a", " a", "a  b", "a\tb\n", "Ａé e\u0301", "x" + BLANK + "y", "\x00\x7f", "   ")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up = np.full(n, BASE, np.uint64)
            down = np.full(n, pow(BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class PieceCodec:
    """Encoder and decoder of one BPE model file with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        scores = [library.get_score(i) for i in range(size)]
        self.begin, self.end = library.bos_id(), library.eos_id()
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.bytes = np.zeros(256, np.int64)
        found = [i for i in range(size) if library.is_byte(i)]
        if len(found) != 256:
            raise ValueError("the model has no byte fallback")
        for i in found:
            self.bytes[int(names[i][3:5], 16)] = i
        ids = {names[i]: i for i in plain}
        # characters: their symbol is the piece itself, or a number beyond the vocabulary
        self.symbol = np.arange(CODES, dtype=np.int64) + size
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        symbol_of = lambda part: ids.get(part, self.symbol[ord(part)] if len(part) == 1 else None)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        rank = {name: order[scores[i]] for name, i in ids.items()}
        pairs: dict[int, tuple[int, int]] = {}
        extended: dict[str, int] = {}
        inner: set[tuple[str, str]] = set()
        for name, i in ids.items():
            inner.update(zip(name, name[1:], strict=False))
            for cut in range(1, len(name)):
                left, right = symbol_of(name[:cut]), symbol_of(name[cut:])
                for part in (name[:cut], name[cut:]):
                    extended[part] = min(extended.get(part, rank[name]), rank[name])
                if left is not None and right is not None:
                    pairs[int(left) * (size + CODES) + int(right)] = (i, rank[name])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, NONE)
        self.pair_piece = np.array([pairs[k][0] for k in keys.tolist()] + [-1], np.int64)
        self.pair_rank = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        holders = Counter(rank.values())
        self.alone = np.zeros(size, bool)  # pieces of which only the leftmost may merge in a round
        for name, i in ids.items():
            self.alone[i] = extended.get(name, len(order)) <= rank[name] or holders[rank[name]] > 1
        letters = sorted({c for pair in inner for c in pair})
        kind = {c: k + 1 for k, c in enumerate(letters)}
        self.kind = np.zeros(CODES, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in inner:
            self.joins[kind[a], kind[b]] = True
        surface = [b""] * size
        surface[library.unk_id()] = UNKNOWN.encode()
        self.leads = np.zeros(size, bool)  # pieces whose blank is dropped at a text's start
        for name, i in ids.items():
            surface[i] = name.replace(BLANK, " ").encode()
            self.leads[i] = name[0] == BLANK
        for value in range(256):
            surface[self.bytes[value]] = bytes([value])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.powers = _Powers()
        self.table: dict[int, tuple[int, int]] | None = None
        for probe in PROBES:
            if self.encode([probe])[0].tolist() != library.encode(probe):
                raise ValueError("the model's normaliser is not the identity with a leading blank")

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The merges of one part in order of rank and place, from a queue over linked symbols."""
        if self.table is None:
            self.table = dict(zip(self.pair_keys[:-1].tolist(), zip(self.pair_rank.tolist(), self.pair_piece.tolist(), strict=True), strict=False))
        table, width, n = self.table, self.size + CODES, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            found = table.get(symbols[i] * width + symbols[j])
            if found:
                queue.append((found[0], i, j, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(queue)
        push, queue_of = heapq.heappush, queue
        while queue_of:
            _, i, j, a, b, piece = heapq.heappop(queue_of)
            if symbols[i] != a or after[i] != j or symbols[j] != b:
                continue
            symbols[i], symbols[j] = piece, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = table.get(piece * width + symbols[k])
                if found:
                    push(queue_of, (found[0], i, k, piece, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = table.get(symbols[h] * width + piece)
                if found:
                    push(queue_of, (found[0], h, i, symbols[h], piece, found[1]))
        return [s for s in symbols if s >= 0]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over parts given as flat symbols and the parts' lengths; returns the same after the last round."""
        done_symbols: list[np.ndarray] = []
        done_lengths: list[np.ndarray] = []
        done_parts: list[np.ndarray] = []
        parts = np.arange(len(lengths))
        while len(parts):
            starts = np.cumsum(lengths) - lengths
            key = np.full(len(symbols), NONE)
            key[:-1] = symbols[:-1] * (self.size + CODES) + symbols[1:]
            key[starts + lengths - 1] = NONE - 1
            at = np.searchsorted(self.pair_keys, key)
            at[self.pair_keys[at] != key] = len(self.pair_keys) - 1
            hit = self.pair_piece[at] >= 0
            rank = np.where(hit, self.pair_rank[at] << 32 | np.arange(len(symbols)), NONE)
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            if not going.all():  # finished parts leave the arrays
                stays = np.repeat(going, lengths)
                done_symbols.append(symbols[~stays])
                done_lengths.append(lengths[~going])
                done_parts.append(parts[~going])
                if not going.any():
                    break
                symbols, at, rank = symbols[stays], at[stays], rank[stays]
                moved = np.cumsum(stays) - 1
                best, parts, lengths = best[going], parts[going], lengths[going]
                starts = np.cumsum(lengths) - lengths
                first = moved[best & 0xFFFFFFFF]
            else:
                first = best & 0xFFFFFFFF
            chosen = (rank >> 32) == np.repeat(best >> 32, lengths)
            alone = self.alone[self.pair_piece[at[first]]]
            many = alone & (np.add.reduceat(chosen, starts, dtype=np.int64) > QUEUED)
            if many.any():
                for p in np.flatnonzero(many).tolist():
                    done = self._one_by_one(symbols[starts[p] : starts[p] + lengths[p]].tolist())
                    done_symbols.append(np.array(done, np.int64))
                    done_lengths.append(np.array([len(done)]))
                    done_parts.append(parts[p : p + 1])
                if many.all():
                    break
                stays = np.repeat(~many, lengths)
                moved = np.cumsum(stays) - 1
                symbols, at, rank, chosen = symbols[stays], at[stays], rank[stays], chosen[stays]
                first, parts, lengths, alone = moved[first[~many]], parts[~many], lengths[~many], alone[~many]
                starts = np.cumsum(lengths) - lengths
            chosen &= ~np.repeat(alone, lengths)
            # of neighbouring occurrences every second one merges, from the left
            places = np.arange(len(symbols))
            run_start = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), places, 0))
            chosen &= (places - run_start) % 2 == 0
            chosen[first] = True
            symbols = np.where(chosen, self.pair_piece[at], symbols)
            gone = np.append(False, chosen[:-1])
            lengths = lengths - np.add.reduceat(gone, starts, dtype=np.int64)
            symbols = symbols[~gone]
        if not done_parts:
            return symbols, lengths
        order = np.argsort(np.concatenate(done_parts), kind="stable")
        lengths = np.concatenate(done_lengths)
        starts = np.cumsum(lengths) - lengths
        return np.concatenate(done_symbols)[_gather(starts[order], lengths[order])], lengths[order]

    def _spell(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their UTF-8 bytes' pieces."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols, lengths
        raw = [chr(c).encode() for c in (symbols[odd] - self.size).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, width)
        out[np.repeat(odd, width)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.add.reduceat(width, np.cumsum(lengths) - lengths)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        normal = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        sizes = np.array([len(t) for t in normal], np.int64)
        flat = code_points("".join(normal))
        n = len(flat)
        if not n:
            return [np.empty(0, np.int64) for _ in texts]
        kind = self.kind[flat]
        cut = np.append(True, ~self.joins[kind[:-1], kind[1:]])
        text_starts = np.cumsum(sizes) - sizes
        cut[text_starts[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, n))
        up, down = self.powers.get(n + 1)
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum((flat + 1).astype(np.uint64) * up[:n]))
            code = (sums[starts + lengths] - sums[starts]) * down[starts]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        same = lengths[first][inverse] == lengths
        if same.all():
            same &= np.logical_and.reduceat(flat[_gather(starts[first][inverse], lengths)] == flat, starts)
        if not same.all():  # two parts share a code: take every part as it is
            first = inverse = np.arange(len(starts))
        symbols = self.symbol[flat[_gather(starts[first], lengths[first])]]
        symbols, counts = self._spell(*self.merge(symbols, lengths[first]))
        places = np.cumsum(counts) - counts
        out = symbols[_gather(places[inverse], counts[inverse])]
        ends = np.append(0, np.cumsum(counts[inverse]))
        bounds = ends[np.searchsorted(starts, np.append(text_starts, n))]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of id sequences; control ids have no text."""
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.empty(0, np.int64)
        width = self.surface_length[flat]
        raw = self.surface[_gather(self.surface_start[flat], width)].tobytes()
        ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(sizes))].tolist()
        return [self._text(raw[a:b], x) for a, b, x in zip(ends[:-1], ends[1:], ids, strict=True)]

    def _text(self, raw: bytes, ids: np.ndarray) -> str:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._lenient(ids))
        shown = ids[self.surface_length[ids] > 0]
        return text[1:] if len(shown) and self.leads[shown[0]] else text

    def _lenient(self, ids: np.ndarray):
        """Surfaces, with a replacement character for every byte that is no part of a character."""
        held = b""
        for i in [*ids.tolist(), None]:
            if i is not None and (self.bytes == i).any():
                held += self.surface[self.surface_start[i]].tobytes()
                continue
            while held:
                for n in range(min(4, len(held)), 0, -1):
                    try:
                        letter = held[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(letter) == 1:
                        break
                else:
                    n, letter = 1, "�"
                yield letter
                held = held[n:]
            if i is not None:
                a = self.surface_start[i]
                yield self.surface[a : a + self.surface_length[i]].tobytes().decode()


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The codec of a model file, loaded once for each worker."""
    return PieceCodec(path)


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text with begin and end.

    ``model`` is the path of a SentencePiece BPE model that every executor can read.  One pass without a shuffle.
    """

    def rows(ids, texts):
        c = codec(model)
        return {"doc_id": ids, "ids": [np.concatenate(([c.begin], x, [c.end])) for x in c.encode(texts)]}

    return map_documents(docs, rows, {"ids": "array<int>"}, id_col, text_col)


def piece_texts(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): decoded id sequences; a null sequence is an empty one."""

    def rows(batches):
        c = codec(model)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.decode(ids), pa.string())], names=["doc_id", "text"])

    named = encoded.select(with_id(encoded, id_col), ids_col)
    return named.mapInArrow(rows, ddl({"doc_id": named.schema["doc_id"].dataType.simpleString(), "text": "string"}))


DIGEST = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def piece_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded with begin and end, then decoded.

    Ids that are no whole numbers are text and kept; an empty table gives an empty result.
    """

    def rows(ids, texts):
        c = codec(model)
        coded = [np.concatenate(([c.begin], x, [c.end])) for x in c.encode(texts)]
        return {
            "doc_id": ids,
            "n_tokens": [len(x) for x in coded],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in c.decode(coded)],
        }

    return map_documents(docs, rows, DIGEST, id_col, text_col, 2_000_000)
