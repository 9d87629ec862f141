"""Passages of at least 20 words repeated across or within documents, by relative Lempel-Ziv parsing.

A document is factored against reference blocks: a factor is a run of its words that also stands earlier (in documents
of smaller ids, or its own before it), taken as long as it goes on there. Factors of at least ``WINDOW`` words are
duplicate spans.

Meeting every reference text with every document would be a cross product, so the reference is dealt into blocks by
content, and a block is met only by what can share a factor with it. Each window of ``WINDOW`` words has an anchor,
its smallest run of ``GRAM`` words: equal windows have equal anchors wherever they stand. An anchor that stands at one
place only begins no factor. Of the others, each place brings the words of its windows to its anchor's block. In
a block the places are parsed in the order of documents: the parse looks up the window at its head in the
block's index of windows; a hit gives the source, and the factor goes on word by word as long as the source does. A greedy
factor ends somewhere, and a window across its border may stand earlier in another place: the parse goes on at the first
window that is not inside the factor and looks up each. Windows no factor covers enter the index.

Before that, windows repeated within a batch are factored there, the batch being a block too, so a passage that very many
documents share sends few places per batch. Anchors that stand at more than ``MOST`` places are dealt out by their
windows instead, so no block grows with the corpus but by the places of one window, of which the index holds one.

Words are compared by 48 bits of their hash each, windows thus by 960 bits and their anchor's 64.

Defined cases: null texts have no words. Texts under ``WINDOW`` words keep all. A null id comes before
all others; ids are integers. Rows that repeat an id with the same text are alike: they get the same spans, and neither
is earlier than the other; rows of one id with other texts are told apart by 64 bits of a text hash, and by their places
as one document's are. Computed columns replace columns of their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.collocations import _among, bit_table
from inkspan.llm.frames import append_columns, bounded_batches, column, fresh_name, key_or_least, parts, stage, text_tag
from inkspan.llm.wordhash import BLANKS, char_index, grams, mix, words_of

WINDOW, GRAM = 20, 8
REACH = WINDOW - GRAM + 1  # runs of GRAM words in a window
MOST = 10_000  # an anchor at more places than this is dealt out by its windows
PART_BYTES = 2 << 20  # of texts worked on at once, but for longer ones
WORD = 6  # bytes of a word's hash in a block

_U = np.uint64


def anchors(words: np.ndarray) -> np.ndarray:
    """For each window of the words the place of its first smallest run."""
    runs = grams(words, GRAM)
    count = len(words) - WINDOW + 1
    best, place = runs[:count].copy(), np.arange(count)
    for k in range(1, REACH):
        less = runs[k : k + count] < best
        best[less] = runs[k : k + count][less]
        place[less] = np.flatnonzero(less) + k
    return place


class Windows:
    """All windows of a batch: row, start (word), hash, and anchor (word and hash)."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = words_of(texts, BLANKS, lower=False)
        row = self.words.row
        if len(row) < WINDOW:
            self.row = self.at = self.anchor = np.zeros(0, np.int64)
            self.hash = self.key = np.zeros(0, _U)
            return
        whole = grams(self.words.hash, WINDOW)
        inside = np.flatnonzero(row[: len(whole)] == row[WINDOW - 1 :])
        place = anchors(self.words.hash)[inside]
        self.row, self.hash = row[inside], whole[inside]
        self.at = inside - self.words.row_ptr[self.row]
        self.anchor = place - self.words.row_ptr[self.row]
        self.key = grams(self.words.hash, GRAM)[place]


def _keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return df.select(key_or_least(id_column).alias("doc"), text_tag(text_column).alias("tag"), text.alias("text"))


def _with_keys(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the keys of ``_keys`` beside their columns, and the names of these."""
    doc, tag = fresh_name(docs, "_doc"), fresh_name(docs, "_tag")
    return docs.withColumns({doc: key_or_least(id_column), tag: text_tag(text_column)}), doc, tag


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for values in columns:
        out[1:] |= values[1:] != values[:-1]
    return out


def repeated_anchors(keyed: DataFrame) -> DataFrame:
    """fp (the anchor's hash) and n of the anchors that stand at two places or more. The returned table is staged."""

    def run(batches):
        for batch in parts(batches, "text", PART_BYTES):
            found = Windows(batch.column("text"))
            kinds, n = np.unique(found.key[_fresh(found.anchor, found.row)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["fp", "n"])

    counted = keyed.mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return stage(counted.filter("n > 1"), "anchors")


def shared_places(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc, tag and places: the anchors of the text that stand elsewhere too, as (at, common).

    A bit table of fixed largest size keeps most others from the join that decides.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(bit_table(repeated))

    def run(batches):
        for batch in parts(batches, "text", PART_BYTES):
            found = Windows(batch.column("text"))
            begin = np.flatnonzero(_fresh(found.anchor, found.row))
            begin = begin[_among(shared.value, found.key[begin])]
            row = found.row[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.key[begin].view(np.int64)), pa.array(batch.column("doc").to_numpy()[row]),
                    pa.array(batch.column("tag").to_numpy()[row]), pa.array(found.anchor[begin].astype(np.int32)),
                ],
                ["fp", "doc", "tag", "at"],
            )

    places = keyed.select("doc", "tag", "text").mapInArrow(run, "fp long, doc long, tag long, at int")
    told = places.join(repeated, "fp").select("doc", "tag", F.struct("at", (F.col("n") > MOST).alias("common")).alias("p"))
    return told.groupBy("doc", "tag").agg(F.collect_set("p").alias("places"))  # numbers of one text


PLACE = "key long, doc long, tag long, at int, words binary, length int, source long, source_at int"


def block_rows(keyed: DataFrame, places: DataFrame, doc: str, tag: str, text: str) -> DataFrame:
    """What goes to the blocks: key, doc, tag, at and words (hashes) of a place; and the factors within a batch.

    A factor comes without words, with length, source (document) and source_at. ``keyed`` is shuffled here with all its
    columns, so that Spark can use the same shuffle again where the spans meet the documents.
    """
    listing = fresh_name(keyed, "_places")

    def run(batches):
        for whole in parts(batches, text, PART_BYTES):
            columns = [column(whole, c) for c in (doc, tag, text, listing)]
            batch = pa.RecordBatch.from_arrays(columns, ["doc", "tag", "text", "places"])
            found, listed = Windows(batch.column("text")), batch.column("places")
            of = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            at, common = (listed.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "common"))
            # Windows of the listed anchors: both sides are numbered by row and word.
            span = int(max(found.anchor.max(initial=0), at.max(initial=0))) + 1
            order = np.argsort(of * span + at)
            asked, hot = (of * span + at)[order], common[order]
            own = found.row * span + found.anchor
            where = np.minimum(np.searchsorted(asked, own), max(len(asked) - 1, 0))
            used = np.flatnonzero(asked[where] == own) if len(asked) else np.zeros(0, np.int64)
            yield from _rows(batch, found, used, hot[where[used]] if len(asked) else np.zeros(0, bool))

    return keyed.join(places.toDF(doc, tag, listing), [doc, tag]).mapInArrow(run, PLACE)


def _rows(batch: pa.RecordBatch, found: Windows, used: np.ndarray, hot: np.ndarray):
    """Rows for the windows ``used`` (in order): factors within the batch, and words of the places left."""
    row, at, anchor, whole = found.row[used], found.at[used], found.anchor[used], found.hash[used]
    doc, tag = batch.column("doc").to_numpy()[row], batch.column("tag").to_numpy()[row]
    # The place before in the order of documents with the same window, if there is one.
    order = np.lexsort((at, doc, whole))
    kinds, steps = _fresh(whole[order]), _fresh(whole[order], doc[order], at[order])
    head = np.flatnonzero(steps)[np.cumsum(steps) - 1]
    before = np.where(kinds[head], -1, head - 1) if len(order) else head
    source = np.full(len(used), -1)
    source[order] = np.where(before >= 0, order[before], -1)
    later = np.flatnonzero(source >= 0)
    from_doc, from_at = doc[source[later]], at[source[later]]
    runs = _fresh(row[later], at[later] - np.arange(len(later)), from_doc, from_at - at[later])
    begin = np.flatnonzero(runs)
    size = np.diff(np.append(begin, len(later))) + WINDOW - 1
    yield _place_batch(
        mix(doc[later[begin]].view(_U) * _U(31) + at[later[begin]].astype(_U)), doc[later[begin]], tag[later[begin]],
        at[later[begin]], None, size, from_doc[begin], from_at[begin],
    )
    # The rest goes to the block of its anchor, or of the window where the anchor is common. A place takes all windows
    # between its first and last one left: they have the same anchor.
    rest = np.flatnonzero(source < 0)
    key = np.where(hot[rest], mix(found.key[used][rest] ^ whole[rest]), found.key[used][rest])
    begin = np.flatnonzero(_fresh(row[rest], anchor[rest], key))
    last = np.append(begin[1:], len(rest)) - 1
    first_word = found.words.row_ptr[row[rest[begin]]] + at[rest[begin]] if len(rest) else begin
    words = at[rest[last]] - at[rest[begin]] + WINDOW if len(rest) else begin
    ptr = np.concatenate([[0], np.cumsum(words)])
    source_words = np.repeat(first_word - ptr[:-1], words) + np.arange(ptr[-1])
    data = found.words.hash[source_words].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()
    packed = pa.Array.from_buffers(
        pa.binary(), len(begin), [None, pa.py_buffer((ptr * WORD).astype(np.int32)), pa.py_buffer(data)]
    )
    pick = rest[begin]
    yield _place_batch(key[begin], doc[pick], tag[pick], at[pick], packed, None, None, None)


def _place_batch(key, doc, tag, at, words, length, source, source_at) -> pa.RecordBatch:
    def whole(values, kind):
        return pa.nulls(len(doc), kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values.astype(kind.to_pandas_dtype()), kind)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)), pa.array(doc), pa.array(tag), whole(at, pa.int32()), whole(words, pa.binary()),
            whole(length, pa.int32()), whole(source, pa.int64()), whole(source_at, pa.int32()),
        ],
        ["key", "doc", "tag", "at", "words", "length", "source", "source_at"],
    )


class Index:
    """The windows of one block and where each stands first."""

    def __init__(self) -> None:
        self.windows: dict[bytes, tuple[int, int, bytes, int]] = {}

    def parse(self, doc: int, at: int, words: bytes) -> list[tuple[int, int, int, int]]:
        """Factors (place, length, source, place there) of a run of words that begins at word ``at`` of ``doc``.

        Runs have to come in the order of (doc, at).
        """
        out, k, last = [], 0, len(words) - WINDOW * WORD
        while k <= last:
            head = words[k : k + WINDOW * WORD]
            source = self.windows.get(head)
            place = at + k // WORD
            if source is None:
                self.windows[head] = (doc, place, words, k)
            elif source[:2] != (doc, place):
                stop, there = k + WINDOW * WORD, source[3] + WINDOW * WORD
                while stop < len(words) and words[stop : stop + WORD] == source[2][there : there + WORD]:
                    stop, there = stop + WORD, there + WORD
                out.append((place, (stop - k) // WORD, source[0], source[1]))
                k = stop - WINDOW * WORD  # the next window is the first over the factor's end
            k += WORD
        return out


def _factor(batches):
    """Factors of the places of each block. Rows come sorted by key, document and place."""
    last, index = None, Index()
    for batch in batches:
        done = batch.filter(pc.is_null(batch.column("words")))
        yield done.select(["doc", "tag", "at", "length", "source", "source_at"])
        rows, asked = [], batch.filter(pc.is_valid(batch.column("words")))
        columns = [asked.column(c).to_pylist() for c in ("key", "doc", "tag", "at", "words")]
        for key, doc, tag, at, words in zip(*columns, strict=True):
            if key != last:
                last, index = key, Index()
            rows += [(doc, tag, *f) for f in index.parse(doc, at, words)]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = ["doc", "tag", "at", "length", "source", "source_at"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


FACTOR = "doc long, tag long, at int, length int, source long, source_at int"


def factors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The factors of all documents: doc, tag (of the text), at and length in words, source (document) and source_at.

    Factors found in several blocks overlap; together they cover every window that also starts earlier.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keys(docs, id_column, text_column)
    places = shared_places(keyed, repeated_anchors(keyed))
    own, doc, tag = _with_keys(docs, id_column, text_column)
    rows = block_rows(own, places, doc, tag, text_column)
    dealt = rows.repartition("key").sortWithinPartitions("key", "doc", "at")
    return dealt.mapInArrow(_factor, FACTOR)


def joined_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, tag and found: packed (at << 32 | length) of its factors, without repeats."""
    packed = F.shiftleft(F.col("at").cast("long"), 32) + F.col("length")
    return factors(docs, id_column, text_column).groupBy("doc", "tag").agg(F.collect_set(packed).alias("found"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by a space) and removed (spans in code points)."""
    bounded_batches(docs.sparkSession)
    keyed, doc, tag = _with_keys(docs, id_column, text_column)
    entry = fresh_name(docs, "_found")
    found = joined_spans(docs, id_column, text_column).toDF(doc, tag, entry)
    joined = keyed.join(found, [doc, tag], "left").select(*docs.columns, entry)

    def make():
        def compute(batch):
            words = words_of(column(batch, text_column), BLANKS, lower=False)
            total = len(words.start)
            change = np.zeros(total + 1, np.int64)
            entries = column(batch, entry)
            ptr = np.concatenate([[0], np.cumsum([len(e) if e.is_valid else 0 for e in entries])]).astype(np.int64)
            packed = entries.flatten().to_numpy().astype(np.int64)
            begin = (packed >> 32) + words.row_ptr[np.repeat(np.arange(len(batch)), np.diff(ptr))]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + (packed & 0xFFFFFFFF), -1)
            covered = np.cumsum(change[:-1]) > 0
            texts, spans, removed = [], [], []
            chars = None
            data = words.data.tobytes()
            blank_after = np.flatnonzero(BLANKS[words.data])
            for k in range(len(batch)):
                a, b = words.row_ptr[k], words.row_ptr[k + 1]
                stop, gone = words.offsets[k + 1], covered[a:b]
                if not gone.any():
                    texts.append(b" ".join(data[words.offsets[k] : stop].split()))
                    spans.append([])
                    removed.append(0)
                    continue
                if chars is None:
                    chars = char_index(words.data, words.offsets)
                own = data[words.offsets[k] : stop].split()
                texts.append(b" ".join([own[i] for i in np.flatnonzero(~gone)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                base, listed = chars[words.offsets[k]], []
                for first, last in zip(edge[::2], edge[1::2], strict=True):
                    begin = words.start[a + last - 1]
                    gap = np.searchsorted(blank_after, begin)
                    end = min(blank_after[gap], stop) if gap < len(blank_after) else stop
                    listed.append({"start": int(chars[words.start[a + first]] - base), "end": int(chars[end] - base)})
                spans.append(listed)
                removed.append(int(gone.sum()))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [
                pa.array(np.diff(words.row_ptr), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                pa.array(spans, kind),
            ]

        return compute

    ddl = "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
    return append_columns(joined, make, ddl).drop(entry)
