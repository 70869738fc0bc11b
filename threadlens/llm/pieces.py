"""SentencePiece encoding and decoding by a streaming Viterbi search.

A position of the text is a node, a vocabulary piece that ends there an edge.
The search walks the text once and keeps for each position of a window as long
as the longest piece the best edge into it (its backpointer). Whenever the
backpointer paths of all positions that a later piece can still start from
meet in one boundary, the ids before it are committed and forgotten, so memory
is bounded by the window and not by the text.

* ``unigram`` models: the best path has the largest sum of piece scores.
* ``bpe`` models: scores are merge ranks and don't add up, so sums would give
  other ids than the vocabulary stands for. A path is worth 0 if any two
  neighbouring pieces are what merging their characters by rank gives, and is
  ruled out otherwise; exactly one such edge ends at each position, and the
  surviving path is the merge encoding (tests hold the ids against the
  sentencepiece library). Runs of white space, whose pieces all have one rank,
  are merged leftmost first, as the library does.

Between two characters that stand side by side in no piece (a letter before a
white-space mark, most letters beside punctuation) no edge passes, so all paths
meet there. The text between two such places is a search of its own, and the
ids of short ones are remembered in a bounded table. The vocabulary is a file of fixed size; it is
read on the driver, from a path that is a parameter, and broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, texts

PIECES_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs below the lowest score of a unigram model (fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: Neighbouring characters are looked up in a table below this code point; others are taken to stand together.
_TABLE = 0x250
#: Remembered are chunks of at most so many characters, and so many of them; what was used since the last time the
#: table was full stays for the next.
_SHORT, _MEMORY = 48, 300_000
_NEVER = float("inf")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _place(char: str) -> int:
    """Row of a character in the table of neighbours; the mark stands at the blank's."""
    return 32 if char == SPACE else ord(char) if ord(char) < _TABLE else 0


class Vocabulary:
    """The pieces of a model file. Other models than unigram and BPE, and user
    defined symbols, are refused."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        if kind not in (UNIGRAM, BPE) or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE, 5) for _, _, t in pieces):
            raise ValueError("unigram and BPE models without user defined symbols only")
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.pieces = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.together = np.ones((_TABLE, _TABLE), bool)  # row and column 0: any other character
        self.together[1:, 1:] = False
        self.longest_by_end: dict[str, int] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.together[_place(a), _place(b)] = True
            self.longest_by_end[p[-2:]] = max(len(p), self.longest_by_end.get(p[-2:], 1))
        #: white-space pieces of one rank: their runs are merged, not searched
        self.tied = kind == BPE and not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From another one's ``vars``, which a broadcast can hand to workers
        that don't have this package."""
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    @classmethod
    def load(cls, path: str = PIECES_PATH) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that take the text as it is")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type,
                   norm.add_dummy_prefix)


class Tokenizer:
    """Encodes and decodes with one vocabulary; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[tuple[int, int], bool] = {}
        self.old_fits: dict[tuple[int, int], bool] = {}
        self.cost = {p: -vocabulary.scores[i] for p, i in vocabulary.ids.items()}.get
        self.short: dict[str, bytes] = {}
        self.old_short: dict[str, bytes] = {}
        self.surface = [p.replace(SPACE, " ") for p in vocabulary.pieces]
        self.surface[vocabulary.unknown] = " ⁇ "
        for i, t in enumerate(vocabulary.types):
            if t == CONTROL:
                self.surface[i] = ""
        self.byte_of = {i: b for b, i in vocabulary.bytes.items()}

    # ---- encoding

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.v.dummy_prefix:
            text = " " + text
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = np.where(points < _TABLE, points, np.where(points == ord(SPACE), 32, 0))
        cuts = (np.flatnonzero(~self.v.together[places[:-1], places[1:]]) + 1).tolist()
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        known = self.short
        return np.frombuffer(b"".join([known.get(c) or self._chunk(c) for c in chunks]), np.int32)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk, four bytes each."""
        ids = self.old_short.get(chunk)
        if ids is None:
            marked = chunk.replace(" ", SPACE)
            if self.v.tied and marked.startswith(SPACE * 2):
                found = self._run(marked)
            elif self.v.kind == BPE and len(chunk) <= _SHORT:
                found = self._short_bpe(marked)
            else:
                found = self.stream(marked)
            ids = np.fromiter(found, np.int32).tobytes()
        if len(chunk) <= _SHORT:
            if len(self.short) >= _MEMORY:
                self.old_short = dict(self.short)
                self.short.clear()
            self.short[chunk] = ids
        return ids

    def _run(self, chunk: str) -> Iterator[int]:
        """Several marks before a word: the last one belongs to the word if a
        piece takes it there, the others merge among themselves."""
        word = chunk.lstrip(SPACE)
        run = len(chunk) - len(word)
        tail = list(self.stream(SPACE + word)) if word else []
        if tail and self.v.pieces[tail[0]] != SPACE:
            run -= 1
        else:
            tail = tail[1:]
        yield from (self.v.ids[p] for p in self.merged(SPACE * run))
        yield from tail

    def _short_bpe(self, text: str) -> list[int]:
        """``stream`` for a text within one window: the same edges in two lists."""
        get, fits, reach = self.v.ids.get, self.fits, self.v.longest_by_end.get
        start, last = [0], [-1]
        for i in range(1, len(text) + 1):
            for j in range(max(0, i - reach(text[max(0, i - 2):i], 1)), i):
                piece = get(text[j:i])
                if piece is not None:
                    ok = fits.get((last[j], piece))
                    if ok if ok is not None else self._fit(last[j], piece):
                        break
            else:
                j, piece = i - 1, -1
            start.append(j)
            last.append(piece)
        out: list[int] = []
        i = len(text)
        while i:
            j = start[i]
            if last[i] >= 0:
                out.append(last[i])
            else:
                out += reversed(self._unknown(text[j:i]))
            i = j
        out.reverse()
        return out

    def stream(self, text: str) -> Iterator[int]:
        """Ids of ``text`` as they are committed."""
        v, longest = self.v, self.v.longest
        edge = self._bpe_edge if v.kind == BPE else self._unigram_edge
        best: dict[int, tuple[int, int, float]] = {0: (0, -1, 0.0)}  # position: (start of its edge, id, path score)
        done = 0
        for i in range(1, len(text) + 1):
            best[i] = edge(text, i, max(done, i - longest), best)
            if i - done >= 4 * longest:
                alive = set(range(i - longest + 1, i + 1))
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(best[last][0])
                meet = alive.pop()
                if meet > done:
                    yield from self._commit(text, best, done, meet)
                    for k in [k for k in best if k < meet]:
                        del best[k]
                    done = meet
        yield from self._commit(text, best, done, len(text))

    def _commit(self, text: str, best: dict, done: int, meet: int) -> list[int]:
        out: list[list[int]] = []
        while meet > done:
            start, piece, _ = best[meet]
            out.append([piece] if piece >= 0 else self._unknown(text[start:meet]))
            meet = start
        return list(chain.from_iterable(reversed(out)))

    def _unknown(self, char: str) -> list[int]:
        return [self.v.bytes[b] for b in char.encode()] if self.v.bytes else [self.v.unknown]

    def _unigram_edge(self, text: str, i: int, low: int, best: dict) -> tuple[int, int, float]:
        """The largest sum; the longest piece at a tie."""
        ids, scores = self.v.ids, self.v.scores
        found, at = None, (0, 0, 0.0)
        for j in range(low, i):
            piece = ids.get(text[j:i])
            if piece is None:
                if j < i - 1:
                    continue
                score = best[j][2] + self.v.unknown_score
                piece = -1
            else:
                score = best[j][2] + scores[piece]
            if found is None or score > found:
                found, at = score, (j, piece, score)
        return at

    def _bpe_edge(self, text: str, i: int, low: int, best: dict) -> tuple[int, int, float]:
        """The one piece that merging leaves at the end of ``text[:i]``."""
        ids, fits = self.v.ids, self.fits
        for j in range(low, i):
            piece = ids.get(text[j:i])
            if piece is not None:
                ok = fits.get((best[j][1], piece))
                if ok if ok is not None else self._fit(best[j][1], piece):
                    return j, piece, 0.0
        return i - 1, -1, 0.0

    def _fit(self, before: int, piece: int) -> bool:
        """Do these two pieces stay as they are when their characters are
        merged? (-1: the start, or an unknown character; nothing merges over it)"""
        pieces = self.v.pieces
        ok = self.old_fits.get((before, piece))
        if ok is not None:
            pass
        elif before < 0:
            ok = len(self.merged(pieces[piece])) == 1
        else:
            pair = self.merged(pieces[before] + pieces[piece])
            ok = len(pair) == 2 and pair[1] == pieces[piece]
        if len(self.fits) >= _MEMORY:
            self.old_fits, self.fits = self.fits, {}
        self.fits[before, piece] = ok
        return ok

    def merged(self, text: str) -> list[str]:
        """The characters merged pair by pair: the best rank first, the leftmost at a tie."""
        if len(text) > 2 * _SHORT:
            return self._merged_long(text)
        cost = self.cost
        part = list(text)
        ranks = [cost(a + b, _NEVER) for a, b in zip(part, part[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            part[i:i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = cost(part[i - 1] + part[i], _NEVER)
            if i < len(ranks):
                ranks[i] = cost(part[i] + part[i + 1], _NEVER)
        return part

    def _merged_long(self, text: str) -> list[str]:
        """``merged`` with a heap, for texts of any length."""
        part = list(text)
        right = list(range(1, len(part) + 1))
        left = list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < len(part):
                cost = self.cost(part[a] + part[b])
                if cost is not None:
                    heapq.heappush(heap, (cost, a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not part[a] or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, ""
            right[a] = right[b]
            if right[b] < len(part):
                left[right[b]] = a
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [p for p in part if p]

    # ---- decoding

    def decode(self, ids) -> str:
        """The text of ``ids``: runs of byte pieces as UTF-8 (a wrong byte as
        U+FFFD), control pieces as nothing, without the leading dummy blank."""
        surface, byte_of = self.surface, self.byte_of
        if byte_of and not byte_of.keys().isdisjoint(ids):
            out: list[str] = []
            run = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(surface[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join([surface[i] for i in ids])
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


def _of_worker(state: dict) -> Tokenizer:
    """The tokenizer of this Python worker: kept beside its copy of the
    broadcast vocabulary, so what it remembers serves the worker's next tasks."""
    if "tokenizer" not in state:
        state["tokenizer"] = Tokenizer(Vocabulary.of(state))
    return state["tokenizer"]


def _int_lists(lists: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids",
           check_col: str = "round_trip") -> DataFrame:
    """All columns of ``docs`` with the ids of its text (array<int>) and
    whether decoding them gives the text back; columns of these names are
    replaced.

    A null or empty text has no ids. A text that holds U+2581, the mark that
    stands for a blank, is the only one that does not come back. Every row,
    repeated or not, is encoded by itself; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(vocabulary)))
    kept = docs.drop(*[c for c in docs.columns if c in (ids_col, check_col)])
    names = kept.columns
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    at = names.index(text_col)

    def rows(batch: pa.RecordBatch) -> dict:
        tokenizer = _of_worker(shared.value)
        ids, back = [], []
        for text in texts(batch.column(at)):
            found = tokenizer.encode_array(text)
            ids.append(found)
            back.append(tokenizer.decode(found.tolist()) == text)
        return {c: batch.column(i) for i, c in enumerate(names)} | {ids_col: _int_lists(ids), check_col: back}

    return map_batches(kept, rows, ", ".join([*fields, f"`{ids_col}` array<int>", f"`{check_col}` boolean"]))


def decode(rows_of_ids: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns with the decoded text; null or empty ids give ''. Ids
    outside the vocabulary are an error."""
    shared = rows_of_ids.sparkSession.sparkContext.broadcast(dict(vars(vocabulary)))
    kept = rows_of_ids.drop(*[c for c in rows_of_ids.columns if c == text_col])
    names = kept.columns
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    at = names.index(ids_col)

    def rows(batch: pa.RecordBatch) -> dict:
        tokenizer = _of_worker(shared.value)
        return {c: batch.column(i) for i, c in enumerate(names)} | {
            text_col: [tokenizer.decode(x or []) for x in batch.column(at).to_pylist()]}

    return map_batches(kept, rows, ", ".join([*fields, f"`{text_col}` string"]))


def pieces_query(spark, sf_dir: str) -> DataFrame:
    """Op 9: ids of every document, and whether they decode to its text."""
    from threadlens.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode(docs, Vocabulary.load())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
