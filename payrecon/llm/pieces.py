"""Operator 11, SentencePiece encoding and decoding with merge-type vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, bounded_batches, table

#: What stands for a blank inside pieces; a fixed value.
BLANK = "▁"
#: Segments (or an eighth of their ids) remembered by a Python worker in each of two generations; characters of texts at a
#: time; segments in a text that the library is asked about.
KEPT, AT_ONCE, ASKED = 200_000, 4 << 20, 32
#: Kinds of pieces in a model file; fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Merge-type models in a model file; a fixed value.
MERGES = 2
#: No symbol; the cost of a pair that does not merge; segments of up to so many characters are merged side by side, in
#: matrices of up to ROW_CELLS cells.
GAP, NEVER, BY_ROWS, ROW_CELLS = -1, np.int32(1 << 30), (8, 16, 32, 64), 1 << 19


class Vocabulary:
    """A merge-type vocabulary: `cost` of each piece (what is merged first costs least), `ids`, and ids of bytes.

    Refused: models of other types, with a table of normalisation or with blanks taken out, with user-defined or
    unused pieces, or without pieces for bytes; their texts would need rules that are not here.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        file = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, kinds = file.normalizer_spec, {p.type for p in file.pieces}
        if file.trainer_spec.model_type != MERGES or norm.precompiled_charsmap or norm.remove_extra_whitespaces or file.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model over texts as they are")
        if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or sum(p.type == BYTE for p in file.pieces) != 256:
            raise ValueError("user-defined or unused pieces, or no pieces for bytes")
        normal = [(i, p.piece, -p.score) for i, p in enumerate(file.pieces) if p.type == NORMAL]
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.ids = {piece: i for i, piece, _ in normal}
        self.cost = {piece: cost for _, piece, cost in normal if len(piece) > 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(file.pieces) if p.type == BYTE}
        #: Neighbours that occur in some piece: between any others no merge can happen, so a text may be cut there.
        self.glued = {a + b for piece in self.cost for a, b in pairwise(piece)}
        order = sorted({*self.cost.values()})
        rank, splits = dict(zip(order, range(len(order)), strict=True)), []
        for piece, cost in self.cost.items():
            splits += [(self.ids[piece[:i]] , self.ids[piece[i:]], rank[cost], self.ids[piece]) for i in range(1, len(piece)) if piece[:i] in self.ids and piece[i:] in self.ids]
        self.width = len(file.pieces) + 1
        table = np.array(sorted((a * self.width + b, c, i) for a, b, c, i in splits) + [(1 << 62, 0, 0)], dtype=np.int64)
        #: Pairs of symbols (numbers of pieces) in order, the rank of their merge by score, and what they merge to.
        self.pair_keys, self.pair_costs, self.pair_ids = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        #: The symbol of each character that is a piece.
        self.symbol_of = np.full(0x110000, GAP, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.symbol_of[ord(" ")] = self.symbol_of[ord(BLANK)]  # as the library has it
        self.end = next(i for i, p in enumerate(file.pieces) if p.type == CONTROL and p.piece == (file.trainer_spec.eos_piece or "</s>"))

    def one_by_heap(self, text: str) -> list[int]:
        """The ids of one segment; its agenda is a heap. An entry is out of date if its left symbol is gone or the pair has
        another length by now."""
        symbols, n, cost = list(text.replace(" ", BLANK)), len(text), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := cost.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left, j = symbols[i], after[i]
            if not left or j == n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i], symbols[j] = left, _ = left + symbols[j], ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
            for at, pair in ((i, left + symbols[k] if k < n else ""), (h, symbols[h] + left if h >= 0 else "")):
                if (c := cost.get(pair)) is not None:
                    heappush(agenda, (c, at, len(pair)))
        out = []
        for s in filter(None, symbols):
            known = self.ids.get(s)
            out += [known] if known is not None else [self.bytes[b] for b in s.encode("utf-8", "replace")]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, id) of what pairs of symbols merge to; NEVER where they do not."""
        asked = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_keys, asked)
        found = self.pair_keys[at] == asked
        return np.where(found, self.pair_costs[at], NEVER), self.pair_ids[at]

    def _rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the segments that are the rows of `symbols` (filled up with the symbol GAP); the agenda of each is its row of
        costs, of which all rows take their least at a time, the leftmost of equals. Gives (symbols, which are alive)."""
        n, length = symbols.shape
        symbols = np.concatenate((symbols, np.full((n, 2), GAP, dtype=np.int32)), axis=1)  # two columns of edge
        cost, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        after = np.tile(np.arange(1, length + 3, dtype=np.int32), (n, 1))
        before = after - 2
        alive, rows = symbols != GAP, np.arange(n)
        while len(rows):
            at = np.argmin(cost[rows], axis=1)
            go = cost[rows, at] < NEVER
            rows, at = rows[go], at[go]
            gone = after[rows, at]
            next_ = after[rows, gone]
            symbols[rows, at] = made[rows, at]
            alive[rows, gone], after[rows, at], before[rows, next_] = False, next_, at
            cost[rows, gone] = NEVER
            cost[rows, at], made[rows, at] = self._pairs(symbols[rows, at], symbols[rows, next_])
            has = before[rows, at] >= 0
            r, i = rows[has], at[has]
            h = before[r, i]
            cost[r, h], made[r, h] = self._pairs(symbols[r, h], symbols[r, i])
        return symbols, alive

    def merged(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, as bytes of 32-bit integers, by an agenda of its adjacent pairs: the cheapest pair is
        merged first, the left one of equals. Short segments of known characters go through it side by side."""
        out = [b""] * len(segments)
        sizes = np.array([*map(len, segments)], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = self.symbol_of[np.frombuffer("".join(segments).encode("utf-32-le", "replace"), dtype="<u4")]
        odd = np.add.reduceat(flat == GAP, starts) > 0 if len(flat) else np.zeros(0, dtype=bool)
        odd |= sizes > BY_ROWS[-1]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.one_by_heap(segments[i]), dtype=np.int32).tobytes()
        for least, most in pairwise((0, *BY_ROWS)):
            for some in np.array_split(np.flatnonzero(~odd & (sizes > least) & (sizes <= most)), 1 + len(sizes) * most // ROW_CELLS):
                if len(some):
                    columns = np.arange(most)
                    inside = columns < sizes[some, None]
                    symbols, alive = self._rows(np.where(inside, flat[np.minimum(starts[some, None] + columns, len(flat) - 1)], GAP))
                    ids, ends = symbols[alive].astype(np.int32).tobytes(), 4 * np.cumsum(alive.sum(axis=1))
                    for i, a, b in zip(some.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                        out[i] = ids[a:b]
        return out


class _Known(dict):
    """Numbers of segments, in the order in which they were first asked for, and where the ids of each are."""

    def __init__(self) -> None:
        self.ids, self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        return number

    def learn(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the numbers that have none yet."""
        self.starts, self.sizes = np.append(self.starts, len(self.ids) + starts), np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids)

    def spelled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of segments by number."""
        sizes = self.sizes[numbers]
        return self.ids[np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes


class PieceEncoder:
    """Texts to ids and back, a batch at a time; with `check`, held against the sentencepiece library.

    Each different segment is compared when it is made, among others in a text of segments and line ends, as is the first
    text of a batch; as no piece of the vocabulary spans a cut, texts of equal segments are equal. Each text must also come
    back from the library's decode of its ids, or is compared whole. Where texts cannot be cut all are compared whole.
    """

    def __init__(self, model: bytes, check: bool) -> None:
        import sentencepiece

        self.vocabulary, self.check, self.known, self.old = Vocabulary(model), check, _Known(), _Known()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: Blanks begin a segment and line ends stand alone, if no piece says otherwise; else a text is one segment.
        self.whole = any(pair[1] == BLANK != pair[0] or "\n" in pair for pair in self.vocabulary.glued)
        self.segments = (lambda text: [text]) if self.whole else re.compile(" *[^ \n]+| +|\n").findall

    def _batches(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """Segments of the texts, of some AT_ONCE characters at a time; a longer text is alone."""
        part, held, prefix = [], 0, self.vocabulary.prefix and " "
        for text in texts:
            if part and held + len(text) > AT_ONCE:
                yield part
                part, held = [], 0
            part.append(self.segments(prefix + text.replace(BLANK, " ")) if text else [])
            held += len(text)
        yield part

    def _learn(self) -> None:
        """Finds or makes the ids of the segments that have been asked for first just now."""
        known, old = self.known, self.old
        first, new = len(known.sizes), [*islice(known, len(known.sizes), None)]
        place = np.fromiter((old.get(s, -1) for s in new), np.int64, len(new))
        there, lack = place >= 0, [s for s, at in zip(new, place.tolist(), strict=True) if at < 0]
        made = self.vocabulary.merged(lack)
        sizes = np.zeros(len(new), dtype=np.int64)
        found, sizes[there] = old.spelled(place[there])
        sizes[~there] = [len(x) // 4 for x in made]
        order = np.argsort(~there, kind="stable")  # those found, then those made
        starts = np.zeros(len(new), dtype=np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        known.learn(np.concatenate((found, np.frombuffer(b"".join(made), dtype=np.int32))), starts, sizes)
        if self.check and not self.whole and lack:
            self._hold_segments(lack, first + np.flatnonzero(~there))

    def _hold_segments(self, segments: list[str], numbers: np.ndarray) -> None:
        """Compares segments with the library, in texts of line ends with a segment behind each."""
        blank, line_end = self.known[" "], self.known["\n"]
        asked = ["\n" + "\n".join(segments[i : i + ASKED]) for i in range(0, len(segments), ASKED)]
        firsts = np.arange(0, len(segments), ASKED)
        sizes = 2 * np.diff(np.append(firsts, len(segments)))
        row = np.stack((np.full_like(numbers, line_end), numbers), axis=1).ravel()
        if self.vocabulary.prefix:
            row, sizes = np.insert(row, 2 * firsts, blank), sizes + 1
        self._hold(asked, *self._ended(row, sizes))

    def _hold(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        theirs = self.library.encode(texts, add_bos=False, add_eos=True, num_threads=1)
        if sizes.tolist() != [*map(len, theirs)] or not np.array_equal(ids, np.fromiter(chain.from_iterable(theirs), np.int32, len(ids))):
            raise ValueError("ids differ from those of the library")

    def _ended(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts of so many segments each, with the end id behind each text."""
        ids, sizes = self.known.spelled(numbers)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        return np.insert(ids, ends, self.vocabulary.end), np.diff(ends, prepend=0) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts, each with the end id behind it."""
        try:
            return self._encode(texts)
        except BaseException:  # what has not been compared must not be remembered
            self.known, self.old = _Known(), _Known()
            raise

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for part in self._batches(texts):
            known = self.known
            known[" "], known["\n"]  # have numbers: what is compared is made of them
            counts = np.array([*map(len, part)], dtype=np.int64)
            numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(part)), np.int64, counts.sum())
            self._learn()
            out.append(self._ended(numbers, counts))
            if len(known) > KEPT or len(known.ids) > 8 * KEPT:
                self.known, self.old = _Known(), known
        ids, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
        if self.check and len(texts):
            some = len(texts) if self.whole else 1
            self._hold(texts[:some], ids[: sizes[:some].sum()], sizes[:some])
        return ids, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        ends = np.cumsum(sizes).tolist()
        return [self.library.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)]

    def both(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, sizes, decoded texts); a text that does not come back as it was is compared whole."""
        ids, sizes = self.encode(texts)
        decoded = self.decode(ids, sizes)
        if self.check and not self.whole:
            ends = np.cumsum(sizes)
            for i in [i for i, (text, back) in enumerate(zip(texts, decoded, strict=True)) if text.replace(BLANK, " ") != back]:
                self._hold([texts[i]], ids[ends[i] - sizes[i] : ends[i]], sizes[i : i + 1])
        return ids, sizes, decoded


class _Model:
    """What a task gets: the model's bytes; each Python worker makes one encoder of them and keeps it with the class."""

    made: dict = {}

    def __init__(self, model: bytes, check: bool) -> None:
        self.key = (model, check)

    def encoder(self) -> PieceEncoder:
        if self.key not in _Model.made:
            _Model.made[self.key] = PieceEncoder(*self.key)
        return _Model.made[self.key]


def piece_columns(spark: SparkSession, text: Column, model_file: str, check: bool = True) -> Column:
    """`struct<ids array<int>, decoded string>` of a text column, for the model in `model_file` (read by the driver).

    `ids` are those of the library's encode with an end id behind them, `decoded` is the library's decode of them.
    """
    bounded_batches(spark)
    with open(model_file, "rb") as file:
        model = file.read()
    Vocabulary(model)  # refuses what it cannot do before a task begins
    shipped = Shipped(spark, _Model(model, check))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def pieces(texts: pa.Array) -> pa.Array:
        encoder = shipped.get().encoder()
        ids, sizes, decoded = encoder.both([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return pieces(text.cast("binary"))


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """`doc_id, ids, decoded` of every row of docs.

    A text is cut into segments (blanks and what follows them) where no piece of the vocabulary spans the cut, and each
    different segment goes through an agenda of adjacent pairs, the best score first. Segments that come again are
    remembered, within a bound. With `check` the ids of each Arrow batch are compared with the library's, and a
    difference fails the job.

    Defined cases: null and empty texts have the end id alone and decode to an empty text; a text is encoded whole,
    however long; characters that no piece holds become pieces for their bytes; repeated rows are encoded each; a null
    id comes out as null; an empty table gives an empty table; other columns are not read.

    At scale: narrow; a worker holds one batch of 4 MB of texts and its bounded memory of segments.
    """
    both = piece_columns(docs.sparkSession, F.col(text_col), model_file, check)
    return docs.select(F.col(id_col).alias("doc_id"), both.alias("_both")).select("doc_id", "_both.ids", "_both.decoded")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_pieces(table(spark, sf_dir, "documents"), default_model())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
