"""Token ids in ORC: ids of each document with an end id behind, in the order of document ids.

The integer columns are run-length encoded by the format; stripes are read side by side, and the row index and the Bloom
filters on the document ids let a reader pass over what it does not ask for.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices
from hearthwatch.session import scratch_dir

END = 0  # fixed value: the id behind each document
PARTS = 1 << 19  # strings whose ids a worker keeps, besides those of one slice
PART_LENGTH = 64  # longer ones (in bytes) are not kept
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # punctuation that may stand behind a word
# Latin letters up to U+024F, and white space by any definition of it
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]))
WHITE = "".join(filter(str.isspace, map(chr, range(0x3001))))
SINGLE = f"^[^{WHITE}]+(\n[^{WHITE}]+)+$"  # lines that are not empty and hold no other white space
WORD = f"^ ?[^{WHITE}]+$"  # with the space before it, if there is one
LINES = 128  # words that are encoded as one text: more take the library longer a word
GROUP = 1 << 17  # characters that the library encodes at once (a longer text comes alone)
LAYOUT = {
    "compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "part int, place long, row_start long, doc_id long, n_tokens long, ids array<int>"


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct part of them once.

    The tokenizer's pattern lets a space only begin a token or stand in a run of white space, so no token reaches over a
    space behind a character that is not white space. A text is cut there, and its parts are looked up, with the space
    before them if there is one. They are cut further, at single line ends and between letters and punctuation, which no
    token holds together. Texts with a special token's string are encoded whole. Arrow cuts, looks up and joins whole
    columns; ids travel as bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        by_bytes = isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.library.pre_tokenizer.add_prefix_space
        self.splits = by_bytes and self.library.normalizer is None and self.library.post_processor is None
        line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self.known = Known()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; the library sees few at a time, since what it returns is far larger than the ids."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if text is None or size > GROUP:
                out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(group, add_special_tokens=False)]
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text) + 8
        return out

    def fresh(self, keys: pa.Array) -> pa.Array:
        """Ids of distinct strings. Joined by line ends, which are tokens of their own, many without white space (but a
        space before them) are one text."""
        if self.line_end is None:
            return _binary(self.whole(keys.to_pylist()))
        plain = pc.match_substring_regex(keys, WORD)
        words, others = keys.filter(plain), keys.filter(pc.invert(plain))
        cuts = pa.array([*range(0, len(words), LINES), len(words)], pa.int64())
        texts = pc.binary_join(pa.LargeListArray.from_arrays(cuts, words), _text("\n")).to_pylist() if len(words) else []
        end = np.array([self.line_end], "<u4")
        ids = np.concatenate([x for data in self.whole(texts) for x in (data, end)]) if texts else end[:0]
        ends = np.flatnonzero(ids == self.line_end)  # one behind each word
        offsets = np.concatenate([[0], ends - np.arange(len(ends))])
        of_words = pa.Array.from_buffers(
            pa.large_binary(), len(words), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids[ids != self.line_end].tobytes())])
        return _either(plain.to_numpy(zero_copy_only=False), of_words, _binary(self.whole(others.to_pylist())))

    def ids(self, parts: pa.Array, lead: np.ndarray) -> pa.Array:
        """Ids of parts, with a space before them where `lead` is set."""
        if self.line_end is None:
            return self.known.find(_led(parts, lead), self.fresh)
        # a line end between characters that are not white space is a token of its own
        lined = pc.match_substring_regex(parts, SINGLE).to_numpy(zero_copy_only=False)
        if not lined.any():
            return self._words(parts, lead)
        lines, others = pc.split_pattern(parts.filter(pa.array(lined)), "\n"), parts.filter(pa.array(~lined))
        cuts = lines.offsets.to_numpy().astype(np.int64)
        lead_of_lines = np.zeros(cuts[-1], bool)
        lead_of_lines[cuts[:-1]] = lead[lined]
        found = self._words(pa.concat_arrays([others, lines.flatten()]), np.concatenate([lead[~lined], lead_of_lines]))
        end = pa.scalar(np.array([self.line_end], "<u4").tobytes(), pa.large_binary())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), found.slice(len(others))), end)
        return _either(lined, joined, found.slice(0, len(others)))

    def _words(self, parts: pa.Array, lead: np.ndarray) -> pa.Array:
        """Ids of parts. Words of letters with marks behind are cut between the two, so that a word is encoded once with
        whatever marks it stands."""
        marks = pc.utf8_ltrim(parts, LETTERS)
        sizes = pc.binary_length(marks).to_numpy()
        cut = (sizes > 0) & (sizes < pc.binary_length(parts).to_numpy()) & (pc.binary_length(pc.ascii_ltrim(marks, MARKS)).to_numpy() == 0)
        words = pc.if_else(pa.array(cut), pc.ascii_rtrim(parts, MARKS), parts)
        tails = marks.filter(pa.array(cut)).dictionary_encode()
        found = self.known.find(pa.concat_arrays([_led(words, lead), tails.dictionary]), self.fresh)
        none = pa.array([b""], pa.large_binary())
        behind = np.full(len(parts), len(tails.dictionary))
        behind[cut] = tails.indices.to_numpy()
        behind = pa.concat_arrays([found.slice(len(parts)), none]).take(pa.array(behind))
        return pc.binary_join_element_wise(found.slice(0, len(parts)), behind, none[0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, bytes]:
        """Number of ids of each text, and all their ids one after the other, with the end id behind each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), _text(""))
        if not len(texts):
            return np.zeros(0, np.int64), b""
        whole = np.full(len(texts), not self.splits)
        for string in self.special:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        starts, flat = ends[:-1], split.flatten()
        codes = flat.dictionary_encode()
        names, codes = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        # a token may reach over the space behind white space, or behind another space: there parts stay joined
        sizes = pc.binary_length(names).to_numpy()
        empty, white = sizes == 0, pc.binary_length(pc.utf8_rtrim(names, WHITE)).to_numpy() < sizes
        joins = (empty | white)[codes]
        joins[starts] = white[codes[starts]]
        joins[ends[1:] - 1] = False
        of_whole = np.repeat(whole, np.diff(ends))
        joins &= ~of_whole
        behind = np.zeros(len(codes), bool)  # parts that belong to the one before
        behind[1:] = joins[:-1]
        runs = np.flatnonzero(joins & ~behind)
        members = np.flatnonzero(joins | behind)
        cuts = np.append(np.searchsorted(members, runs), len(members))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), flat.take(pa.array(members))), _text(" "))
        lead = np.ones(len(codes), bool)
        lead[starts] = False
        # distinct parts with a space before them, then joined ones, then first ones of texts
        used = np.zeros(len(names), bool)
        used[codes[lead & ~of_whole & ~joins & ~behind]] = True
        heads = starts[~whole & ~joins[starts]]
        n = int(used.sum())
        parts = pa.concat_arrays([names.filter(pa.array(used)), joined, names.take(pa.array(codes[heads]))])
        found = self.ids(parts, np.concatenate([np.ones(n, bool), lead[runs], np.zeros(len(heads), bool)]))
        end = pa.array([np.array([END], "<u4").tobytes()], pa.large_binary())
        table = pa.concat_arrays([found, _binary(self.whole(texts.filter(pa.array(whole)).to_pylist())), end])
        at = (np.cumsum(used) - 1)[codes]
        at[runs] = n + np.arange(len(runs))
        at[heads] = n + len(runs) + np.arange(len(heads))
        at[starts[whole]] = len(found) + np.arange(int(whole.sum()))
        kept = ~behind & ~(of_whole & lead)  # the first part of a text that is encoded whole stands for all of it
        counts = np.add.reduceat(kept, starts, dtype=np.int64)
        at = np.insert(at[kept], np.cumsum(counts), len(table) - 1)
        lengths = pc.binary_length(table).to_numpy()[at] // 4
        sizes = np.add.reduceat(lengths, np.cumsum(counts + 1) - counts - 1)
        out = table.take(pa.array(at))
        offsets = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1]
        return sizes, memoryview(out.buffers()[2])[offsets[0] : offsets[-1]]


def _either(mask: np.ndarray, yes: pa.Array, no: pa.Array) -> pa.Array:
    """The next value of `yes` where the mask is set, else of `no`."""
    return pa.concat_arrays([yes, no]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(yes) + np.cumsum(~mask) - 1)))


def _binary(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in ids], pa.large_binary())


def _led(parts: pa.Array, lead: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(pa.array(["", " "], pa.large_string()).take(pa.array(lead.astype(np.int8))), parts, _text(""))


class Known:
    """Strings whose ids are kept. When there are too many, those that were looked up last stay, known ones before new ones."""

    def __init__(self) -> None:
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.last, self.now = np.zeros(0, np.int64), 0  # the call that met each of them last

    def find(self, keys: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of all the keys; `make` gives those of new ones."""
        codes = pa.chunked_array([self.keys, keys]).dictionary_encode()
        names, codes = codes.chunk(codes.num_chunks - 1).dictionary, codes.chunk(codes.num_chunks - 1).indices
        ids, last, self.now = self.ids, self.last, self.now + 1
        new = names.slice(len(ids))
        if len(new):
            ids = pa.concat_arrays([ids, make(new)])
            last = np.concatenate([last, np.zeros(len(new), np.int64)])
        last[codes.to_numpy()] = self.now
        out = ids.take(codes)
        kept = np.ones(len(ids), bool)
        kept[len(self.ids) :] = pc.binary_length(new).to_numpy() <= PART_LENGTH
        if int(kept.sum()) > PARTS:
            kept[np.argsort(np.where(kept, -last, 1), kind="stable")[PARTS // 2 :]] = False
        if kept.all():
            self.keys, self.ids, self.last = names, ids, last
        else:
            self.keys, self.ids, self.last = names.filter(pa.array(kept)), ids.filter(pa.array(kept)), last[kept]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def _rows(path: str):
    """Rows of a file: ids with the end id, and where they begin in the file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkEncoder(path))
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in byte_slices(batches, limit=8 << 20):
            sizes, data = encoder.encode(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = np.frombuffer(data, "<u4").astype(np.int32)
            n = len(sizes)
            yield pa.record_batch(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n)), pa.array(start + ends[:-1]),
                 batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                ["part", "place", "row_start", "doc_id", "n_tokens", "ids"],
            )
            place, start = place + n, start + int(ends[-1])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every document and write its ids to ORC files at `path`, in ascending order of `doc_id`.

    `tokenizer` is the path of a tokenizer file, the same on every machine. Files are ranges of `doc_id`, so their
    parts (`part`) follow each other; NULL ids come first, rows of one id in the order of their texts' hash and text,
    which also splits an id that many rows share. A NULL or empty text is the end id alone. Texts are shuffled, and
    encoded where their range is written; a row's place and first token in its part are stored with it.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the driver gets a sample of these to find the ranges
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.mapInArrow(_rows(tokenizer), SCHEMA).write.options(**LAYOUT).mode("overwrite").orc(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Stored rows (see SCHEMA). A condition on `doc_id` passes over files, stripes and row groups by their statistics
    and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if where is None else rows.filter(where)


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, part_start): tokens before each file, from two narrow columns. One row a file."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))


def documents_of(rows: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents by their number."""
    return rows.filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids) of the tokens [start, stop) of the whole sequence, cut out of the documents that they are
    in; the ids of other documents are not read."""
    placed = rows.join(part_starts(rows), "part").withColumn("start", F.col("part_start") + F.col("row_start"))
    met = placed.filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    length = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip
    return met.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), length.cast("int")).alias("ids"))


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
        data = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        yield pa.record_batch(
            [batch.column("part"), batch.column("row_start"), batch.column("doc_id"), pa.array(np.diff(ends) // 4, pa.int64()), pa.array(sums, pa.int64())],
            ["part", "row_start", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_file_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of token files: the tokens before it, its own with the end
    id, and the checksum of their ids as little-endian 32-bit integers.

    Stripes are read side by side: a document's start is its place in its file and the sum of the files before. NULL
    and repeated ids keep a row each; an empty table gives no rows.
    """
    sums = rows.select("part", "row_start", "doc_id", "ids").mapInArrow(_checksums, "part int, row_start long, doc_id long, n_tokens long, ids_crc32 long")
    return sums.join(part_starts(rows), "part").select("doc_id", (F.col("part_start") + F.col("row_start")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files of `docs` (in the shared folder if no path is given) and return what is read back of them."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "tokens")
    write_token_files(docs, tokenizer, path)
    return token_file_rows(read_token_files(spark, path))
