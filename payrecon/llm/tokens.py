"""Operator 4, token ids in ORC files."""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, table

#: What one Python worker remembers of words and their ids, in bytes; and the text that is encoded at a time.
KEPT_BYTES, AT_ONCE = 12 << 20, 4 << 20
#: Longer words are encoded each time; with each portion of text the worth of a word that was not seen fades.
LONGEST_KEPT, FADES = 64, np.float32(0.97)
#: The split of the tokenizer's file, with white space as Unicode has it; fixed values.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: The normaliser and the split of files whose texts may be encoded word by word; fixed values.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
}


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from 256 up."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + b - sum(prints[:b])) for b in range(256)]


_IDS = pa.list_(pa.int32())


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, _IDS)


class Encoder:
    """Tokenizer.encode(text, add_special_tokens=False) of many texts at a time.

    Where the file's normaliser and split are BY_WORDS, white space ends every piece, so the ids of a text are
    those of its words in a row: the words of some texts are told apart by Arrow, each different one is encoded
    once, and the ids are taken together by number. Words that come often are remembered in flat arrays of
    KEPT_BYTES at most. Latin words are cut by the same split, and their pieces go to the tokenizer's model;
    texts that spell a special token, words beyond Latin, and texts of any other tokenizer go through the
    tokenizer as they are.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(spec)
        self.by_words = all(parts.get(k) == v for k, v in BY_WORDS.items())
        self.split = regex.compile(PIECE)
        self.characters = _byte_characters()
        self.words, self.ids, self.worth = pa.array([], pa.string()), pa.array([], _IDS), np.zeros(0, dtype=np.float32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.characters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def _encoded(self, words: list[bytes]) -> pa.ListArray:
        """The ids of words, each of them new; pieces that several words share are encoded once."""
        pieces: dict[str, list[int]] = {}
        out = []
        for word in words:
            text = word.decode("utf-8", "replace")
            if not text.isascii() and max(text) >= "\u0250":
                out += self._whole([text])
                continue
            text, ids = text.lower(), []
            for piece in (text,) if text.isalpha() else self.split.findall(text):  # a run of letters is one piece
                got = pieces.get(piece)
                if got is None:
                    got = pieces[piece] = self._piece(piece)
                ids += got
            out.append(ids)
        return _lists(out)

    def _known(self, words: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """(ids, place): `ids[place[i]]` are those of words[i]. Words seen in many
        portions of text, late ones above all, are remembered."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        all_words = pa.concat_arrays([self.words, new])
        all_ids = pa.concat_arrays([self.ids, self._encoded(new.cast(pa.binary()).to_pylist())])
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = np.arange(len(self.words), len(all_words))
        size = pc.binary_length(all_words).to_numpy(zero_copy_only=False)
        worth = np.concatenate((self.worth * FADES, np.zeros(len(new), dtype=np.float32)))
        worth[place] += 1
        order = np.argsort(-worth, kind="stable")
        order = order[size[order] <= LONGEST_KEPT]
        bytes_of = size + 4 * all_ids.value_lengths().to_numpy(zero_copy_only=False) + 12
        order = order[np.cumsum(bytes_of[order]) <= KEPT_BYTES]
        self.words, self.ids, self.worth = all_words.take(pa.array(order)), all_ids.take(pa.array(order)), worth[order]
        return all_ids, place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts (binary, UTF-8), each with `end_id` behind it; a null is an empty text."""
        if not self.by_words or self._special(texts):
            lists = _lists([[*ids, end_id] for ids in self._whole([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()])])
            return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        texts = pc.fill_null(texts, b"")
        plain = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)  # bytes as they are
        words = pc.ascii_split_whitespace(plain)
        ends = np.cumsum(words.value_lengths().to_numpy())
        numbered = words.flatten().dictionary_encode()
        ids, place = self._known(numbered.dictionary)
        last = pa.concat_arrays([ids, _lists([[end_id]])])
        at = np.insert(place[numbered.indices.to_numpy()], ends, len(ids))  # the end stands behind the last word
        taken = last.take(pa.array(at))
        before = np.concatenate(([0], np.cumsum(taken.value_lengths().to_numpy())))
        return taken.flatten().to_numpy(), np.diff(before[np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))])

    def _special(self, texts: pa.Array) -> bool:
        return any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)

    def portions(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """(from, to) of rows that are encoded together: AT_ONCE bytes or one row; texts with a special token alone."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        alone = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            alone |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(len(texts)):
            if i > start and (held + size[i] > AT_ONCE or alone[i] or alone[i - 1]):
                yield start, i
                start, held = i, 0
            held += size[i]
        if start < len(texts):
            yield start, len(texts)


def _encoder(spec: str) -> Encoder:
    """One for each Python worker: tasks that come later find what earlier ones have learnt."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    key = f"_{zlib.crc32(spec.encode())}"
    if not hasattr(kept, key):
        setattr(kept, key, Encoder(spec))
    return getattr(kept, key)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every row to ORC files below `path`, in ascending id order.

    Columns: `doc_id`, `n_tokens`, `part_start` (ids before this row in its partition), `ids` (with `end_id` at
    the end). Integers are run-length encoded in the stripes; row indexes and a Bloom filter on doc_id let
    readers skip stripes and row groups. Null and empty texts have the end id alone; null ids come first; rows
    that share an id follow each other, ordered by their text; an empty table gives no rows.

    At scale: one shuffle by ranges of the id; encoding comes after it, so nothing is encoded twice; each
    task writes its range, so files are in id order.
    """
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(spec.value), 0
        for batch in batches:
            for a, b in encoder.portions(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, sizes = encoder.encode(part.column(1), end_id)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                starts = pa.array(before + offsets[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), starts, lists], ["doc_id", "n_tokens", "part_start", "ids"])
                before += int(offsets[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens long, part_start long, ids array<int>").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, only: list | None = None) -> DataFrame:
    """The rows written by write_tokens(), with `file`; `only`: these ids, which reach the scan as a filter."""
    rows = spark.read.orc(path)
    if only is not None:
        rows = rows.filter(F.col("doc_id").isin(only))
    return rows.withColumn("file", F.col("_metadata.file_path"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per row of the files: `doc_id, start` (ids of all rows before it), `n_tokens` and `ids_crc32` of its ids.

    The sums over files come from the columns of numbers alone; the one window over all files has a row a file.
    """

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        ids = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        return pa.array([zlib.crc32(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.int64())

    rows = read_tokens(spark, path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"), F.min("part_start").alias("_first"), F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    earlier = Window.orderBy(F.asc_nulls_first("_least"), F.asc_nulls_first("_most"), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select(F.col("file").alias("_file"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    seen = rows.select("doc_id", "file", "part_start", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))
    return seen.join(bases, F.col("file") == F.col("_file")).select("doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return token_index(spark, path)
