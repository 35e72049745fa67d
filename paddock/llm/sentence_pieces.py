"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text is a chain of word lattices, because no piece holds
a space mark after another character; a word's lattice is built once per run
of texts. All words are handled together in numpy:

1. Forward Viterbi gives every position the best score of its prefix and, by
   backtracking, the best segmentation.
2. A backward pass gives the best score of any path through an edge; the best
   one off the best path is the word's exact second-best score.
3. An N-best list of the text can only change the N - 1 words that lose least.
   For these a backward A-star search over the word's lattice lists the N best
   segmentations; the forward scores are its exact heuristic, so paths come out
   in order of score. The lists merge into the N best of the whole text.

Scores are the model's own (``scores="model"``, for unigram models) or Zipf's
law over the order of the pieces (``"zipf"``): the r-th piece has probability
1 / (r * H), where H sums 1 / r over all pieces. A BPE model's scores only say
in which order pieces were merged, and their sums prefer short early pieces;
the order itself is one of frequency, which Zipf's law turns into probabilities
without training. Scores are rounded to multiples of 2^-20, so that sums are
exact whatever their order and A-star meets equal paths as equal.

A character without a piece costs 10 more than the worst piece and is written
as byte pieces. Decoding concatenates the pieces' bytes and restores spaces.
Models are read with the sentencepiece library, which also normalises the text;
nothing is trained.

Defined results: null and empty texts have no ids and one alternative of score
0; texts of one character or of one very long word are handled whole; ties go
to the longer last piece; repeated rows get equal results; other input columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import U64, gather, list_array, map_batches, pieces, span_hashes, utf8

SPACE = "▁"
_CELLS = 1 << 15  # word positions in one numpy block
_BLOCK_WORDS = 8192  # words in one numpy block
_RUN_BYTES = 1 << 19  # bytes of the texts encoded at once
_DECODED = 256  # texts decoded at once
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_TABLE_BITS = 18
_UNIT = float(1 << 20)


@dataclass(frozen=True)
class PieceModel:
    path: str = "/opt/tokenizers/piece_bpe_32k.model"
    nbest: int = 3
    scores: str = "model"


# the given model is BPE
BPE_PIECES = PieceModel(scores="zipf")


def zipf_scores(given: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law over the descending order of the given scores."""
    rank = np.empty(len(given))
    rank[np.argsort(-given, kind="stable")] = np.arange(1, len(given) + 1)
    return -np.log(rank) - np.log((1.0 / rank).sum())


class Pieces:
    """A model's pieces: hash table for the lattice, bytes for decoding."""

    def __init__(self, path: str, kind: str = "model"):
        if kind not in ("model", "zipf"):
            raise ValueError(f"scores are 'model' or 'zipf', not {kind!r}")
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        names, scores, ids = [], [], []
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.unknown = sp.unk_id()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unused(i) or i == self.unknown:
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.encode())
                names.append(piece)
                scores.append(sp.get_score(i))
                ids.append(i)
        self.has_bytes = any(sp.is_byte(i) for i in range(n))
        if kind == "zipf":
            scores = zipf_scores(np.array(scores))
        scores = (np.rint(np.array(scores) * _UNIT) / _UNIT).tolist()
        self.score_of = dict(zip(names, zip(scores, ids, strict=True), strict=True))
        self.unk_score = min(scores) - 10.0
        self.longest = max(map(len, names))
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        # open-addressed table by the hash of the piece's code points
        hashes = np.array([self._hash(p) for p in names], dtype=U64)
        self.slots = np.zeros(1 << _TABLE_BITS, dtype=U64)
        self.slot_piece = np.full(1 << _TABLE_BITS, -1, dtype=np.int64)
        for i, h in enumerate(hashes.tolist()):
            at = h >> (64 - _TABLE_BITS)
            while self.slot_piece[at] >= 0:
                at = (at + 1) % (1 << _TABLE_BITS)
            self.slots[at], self.slot_piece[at] = h, i
        taken = self.slot_piece >= 0
        run, self.probes = 0, 1
        for t in np.concatenate([taken, taken]).tolist():
            run = run + 1 if t else 0
            self.probes = max(self.probes, min(run, 64))
        self.scores, self.ids = np.array([*scores, -np.inf]), np.array([*ids, -1])

    @staticmethod
    def _hash(piece: str) -> int:
        total = 0
        for c in piece:
            total = (total * _P + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return (total ^ len(piece)) * _Q & 0xFFFFFFFFFFFFFFFF

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; the last index (score -inf) for none."""
        out = np.full(hashes.shape, len(self.scores) - 1)
        flat, found = hashes.ravel(), out.ravel()
        at = (flat >> U64(64 - _TABLE_BITS)).astype(np.int64)
        open_ = None
        for _ in range(self.probes):
            have, want = self.slots[at], flat if open_ is None else flat[open_]
            hit = np.flatnonzero(have == want)
            found[hit if open_ is None else open_[hit]] = self.slot_piece[at[hit]]
            more = np.flatnonzero((have != 0) & (have != want))
            if not len(more):
                break
            open_ = more if open_ is None else open_[more]
            at = (at[more] + 1) & (len(self.slots) - 1)
        return out


@lru_cache(maxsize=2)
def load(path: str, scores: str = "model") -> Pieces:
    return Pieces(path, scores)


class Segmented:
    """Best segmentations of distinct words: ids (flat, ``first``, ``count``), score, loss of the second best."""

    def __init__(self, words: list[str], known: Pieces):
        n = len(words)
        self.score, self.loss = np.zeros(n), np.full(n, np.inf)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        order = np.argsort(size, kind="stable")
        parts, owners = [], []
        at, ranked = 0, size[order]
        while at < n:
            # a block holds words of similar length; its cells grow with every further word
            more = ranked[at + 1:at + _BLOCK_WORDS]
            stop = at + 1 + int(np.searchsorted(np.arange(2, len(more) + 2) * more, _CELLS, side="right"))
            block = order[at:stop]
            ids, owner = self._block([words[i] for i in block], size[block], block, known)
            parts.append(ids)
            owners.append(block[owner])
            at = stop
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.count = np.bincount(owner, minlength=n)
        self.ids = ids[np.argsort(owner, kind="stable")]
        self.first = np.cumsum(self.count) - self.count

    def _block(self, words: list[str], size: np.ndarray, block: np.ndarray, known: Pieces):
        # arrays are (position, word), so that one position of all words is contiguous
        n, long = len(words), int(size.max(initial=0))
        points = np.zeros((n, long), dtype=U64)
        inside = np.arange(long)[None, :] < size[:, None]
        points[inside] = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        points, inside = np.ascontiguousarray(points.T), np.ascontiguousarray(inside.T)
        most = min(known.longest, long)
        rolling = np.zeros((long, n), dtype=U64)
        forward = np.full((long + 1, n), -np.inf)
        forward[0] = 0.0
        piece, score = [], []
        for k in range(1, most + 1):  # edges of k characters, by their first character
            width = long - k + 1
            rolling = rolling[:width] * U64(_P) + points[k - 1:] + U64(1)
            found = known.find((rolling ^ U64(k)) * U64(_Q))
            found[~inside[k - 1:]] = len(known.scores) - 1
            value = known.scores[found]
            if k == 1:
                value[inside & np.isneginf(value)] = known.unk_score
            piece.append(found)
            score.append(value)
        back = np.zeros((long + 1, n), dtype=np.int64)
        for i in range(1, long + 1):
            best, how = forward[i], back[i]
            for k in range(min(most, i), 0, -1):
                value = forward[i - k] + score[k - 1][i - k]
                better = value > best
                np.copyto(best, value, where=better)
                how[better] = k
        rows = np.arange(n)
        best = forward[size, rows]
        self.score[block] = best
        # best path, from the end
        place, steps = size.copy(), []
        live = rows[place > 0]
        while len(live):
            k = back[place[live], live]
            place[live] -= k
            steps.append((live, place[live].copy(), k))
            live = live[place[live] > 0]
        # best score through every edge off that path
        behind = np.full((long + 1, n), -np.inf)
        behind[size, rows] = 0.0
        for i in range(long - 1, -1, -1):
            for k in range(1, min(most, long - i) + 1):
                np.maximum(behind[i], score[k - 1][i] + behind[i + k], out=behind[i])
        on_path = np.zeros((long + 1, n), dtype=np.int64)
        for row, start, k in steps:
            on_path[start, row] = k
        second = np.full(n, -np.inf)
        for k in range(1, most + 1):
            through = forward[:long - k + 1] + score[k - 1] + behind[k:]
            through[on_path[:long - k + 1] == k] = -np.inf
            np.maximum(second, through.max(axis=0, initial=-np.inf), out=second)
        self.loss[block] = np.where(np.isneginf(second), np.inf, best - second)
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, start, k = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, row))
        row, start, k = row[order], start[order], k[order]
        ids = np.empty(len(row), dtype=np.int64)
        for width in range(1, most + 1):
            some = k == width
            ids[some] = known.ids[piece[width - 1][start[some], row[some]]]
        gaps = np.flatnonzero(ids < 0)
        if len(gaps):  # characters without a piece become bytes
            repeat = np.ones(len(ids), dtype=np.int64)
            spelled = [spell(chr(int(points[start[g], row[g]])), known) for g in gaps]
            repeat[gaps] = [len(s) for s in spelled]
            where = np.cumsum(repeat) - repeat
            ids, row = np.repeat(ids, repeat), np.repeat(row, repeat)
            for g, s in zip(gaps, spelled, strict=True):
                ids[where[g]:where[g] + len(s)] = s
        return ids, row


def spell(char: str, known: Pieces) -> list[int]:
    return known.byte_id[list(char.encode())].tolist() if known.has_bytes else [known.unknown]


@lru_cache(maxsize=1 << 15)
def word_nbest(word: str, path: str, nbest: int, scores: str = "model") -> tuple[tuple[float, tuple[int, ...]], ...]:
    """The N best segmentations of a word: forward Viterbi, then backward A-star."""
    known, n = load(path, scores), len(word)
    edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    forward = [0.0] + [-np.inf] * n
    for i in range(1, n + 1):
        for j in range(max(0, i - known.longest), i):
            found = known.score_of.get(word[j:i])
            if found is not None:
                edges[i].append((j, found[0], (found[1],)))
            elif j == i - 1:
                edges[i].append((j, known.unk_score, tuple(spell(word[j], known))))
        forward[i] = max(forward[j] + s for j, s, _ in edges[i])
    # entries: -(score of the suffix + exact score of the best prefix), position, order, suffix score, ids as a
    # linked list; among equal scores the path nearest its end goes first, else ties would grow the agenda
    agenda, tick, out = [(-forward[n], n, 0, 0.0, None)], 0, []
    while agenda and len(out) < nbest:
        _, at, _, done, tail = heapq.heappop(agenda)
        if at == 0:
            ids = []
            while tail is not None:
                ids += tail[0]
                tail = tail[1]
            out.append((done, tuple(ids)))
            continue
        for j, s, ids in edges[at]:
            tick += 1
            heapq.heappush(agenda, (-(done + s + forward[j]), j, tick, done + s, (ids, tail)))
    return tuple(sorted(out, key=lambda x: -x[0]))


def merge_nbest(choices: list[tuple[int, tuple[tuple[float, tuple[int, ...]], ...]]], base: float, nbest: int):
    """The N best combinations of word choices: (score, ((word, ids), ...)); the first changes nothing."""
    best = [(base, ())]
    for word, options in choices:
        grown = [(score + s - options[0][0], edits if i == 0 else (*edits, (word, ids)))
                 for score, edits in best for i, (s, ids) in enumerate(options)]
        best = heapq.nsmallest(nbest, grown, key=lambda x: -x[0])
    return best


class Encoded:
    """Ids, scores and N-best alternatives of a run of texts."""

    def __init__(self, texts: pa.Array, model: PieceModel):
        known = load(model.path, model.scores)
        normal = known.sp.normalize([t or "" for t in texts.to_pylist()])
        data, offsets = utf8(pa.array(normal, pa.string()))
        rows = len(texts)
        # a word starts at a space mark (three bytes) that does not follow another, or with the text
        mark = np.zeros(len(data) + 3, dtype=bool)
        if len(data) > 2:
            mark[:len(data) - 2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = mark[:len(data)].copy()
        begins[3:] &= ~mark[:max(len(data) - 3, 0)]
        edge = offsets[:-1][np.diff(offsets) > 0]
        begins[edge] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(offsets, start, side="right") - 1
        hashes = span_hashes(data, start, end)
        _, where, place = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        self.words = [raw[a:b].decode("utf-8") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        found = Segmented(self.words, known)
        self.count = np.bincount(row, weights=found.count[place], minlength=rows).astype(np.int64)
        self.ids = found.ids[gather(found.first[place], found.count[place])].astype(np.int32)
        self.score = np.bincount(row, weights=found.score[place], minlength=rows)
        # decoding: the bytes of the pieces, with the space marks as they are
        decoded = known.piece_bytes[gather(known.piece_start[self.ids], known.piece_size[self.ids])]
        length = np.bincount(np.repeat(np.arange(rows), self.count), weights=known.piece_size[self.ids], minlength=rows)
        same = length == np.diff(offsets)
        if len(decoded) == len(data) and same.all():
            differs = np.flatnonzero(decoded != data)
            same[np.searchsorted(offsets, differs, side="right") - 1] = False
        else:
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            for i in np.flatnonzero(same):
                same[i] = bool((decoded[bounds[i]:bounds[i + 1]] == data[offsets[i]:offsets[i + 1]]).all())
        self.exact = same
        # the words that lose least
        first = np.searchsorted(row, np.arange(rows))
        order = np.lexsort((np.arange(len(row)), found.loss[place], row))
        self.alternatives = []
        for i in range(rows):
            stop = first[i + 1] if i + 1 < rows else len(row)
            some = [w for w in order[first[i]:min(stop, first[i] + model.nbest - 1)].tolist()
                    if np.isfinite(found.loss[place[w]])]
            choices = [(w, word_nbest(self.words[place[w]], model.path, model.nbest, model.scores)) for w in sorted(some)]
            out = []
            for score, edits in merge_nbest(choices, float(self.score[i]), model.nbest):
                change = sum(len(ids) - int(found.count[place[w]]) for w, ids in edits)
                out.append({"score": score, "n_tokens": int(self.count[i]) + change,
                            "edits": [{"word": w - int(first[i]), "ids": list(ids)} for w, ids in edits]})
            self.alternatives.append(out)


ALTERNATIVES = "array<struct<score: double, n_tokens: int, edits: array<struct<word: int, ids: array<int>>>>>"
_ARROW = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int32()), (
    "edits", pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode_run(part: pa.RecordBatch, model: PieceModel, id_col: str) -> pa.RecordBatch:
    """The encoded rows of a run of (id, text); what was built for it is freed before the next run."""
    e = Encoded(part.column("text"), model)
    return pa.RecordBatch.from_arrays(
        [part.column("id"), list_array(pa.array(e.ids), e.count), pa.array(e.count), pa.array(e.score),
         pa.array(e.exact), pa.array(e.alternatives, _ARROW)],
        [id_col, "ids", "n_tokens", "score", "exact", "alternatives"])


def encode(docs: DataFrame, model: PieceModel = PieceModel(), *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids``, ``n_tokens``, ``score``, ``exact`` (decoding gives the
    normalised text) and ``alternatives``, the N best segmentations as edits of single words of the
    best one. A narrow map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (encode_run(part, model, id_col) for part in pieces(batch, "text", _RUN_BYTES))

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, run, f"{id_col} {kind}, ids array<int>, n_tokens long, score double, exact boolean, "
                                    f"alternatives {ALTERNATIVES}")


def _texts(ids: pa.Array, known: Pieces) -> pa.Array:
    """The text of every list of ids; null for null."""
    count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = known.piece_size[flat]
    data = known.piece_bytes[gather(known.piece_start[flat], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        text = raw.cast(pa.large_string())
    except pa.ArrowInvalid:  # byte pieces that are no UTF-8
        text = pa.array([v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.large_string())
    text = pc.replace_substring(text, SPACE, " ")
    text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
    return pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.large_string())).cast(pa.string())


def decode(encoded: DataFrame, model: PieceModel = PieceModel(), *, id_col: str = "doc_id",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, columns of ``keep``) from ids: the pieces' bytes with spaces restored, without the leading
    space that encoding adds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(model.path, model.scores)
        for batch in batches:
            for at in range(0, batch.num_rows, _DECODED):
                part = batch.slice(at, _DECODED)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _texts(part.column(1), known), *part.columns[2:]], [id_col, "text", *keep])

    narrow = encoded.select(F.col(id_col).alias("id"), "ids", *keep)
    types = [f"{id_col} {narrow.schema['id'].dataType.simpleString()}", "text string",
             *[f"{c} {narrow.schema[c].dataType.simpleString()}" for c in keep]]
    return map_batches(narrow, run, ", ".join(types))
