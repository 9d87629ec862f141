"""Files of packed token ids: round trips of the format, and the files against the tokenizers library."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkspan.llm import idfile
from inkspan.llm.frames import table

WIDE = st.integers(0, 63).flatmap(lambda bits: st.integers(0, (1 << (bits + 1)) - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 50_256), WIDE), max_size=300), st.integers(1, 70))
def test_blocks_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, offsets = idfile.pack_blocks(ids, block)
    assert offsets[-1] == len(words) and len(offsets) == -(-len(ids) // block) + 1
    sizes = np.minimum(block, len(ids) - np.arange(0, len(ids), block))
    assert np.array_equal(idfile.unpack_blocks(words, offsets, sizes), ids)
    for k in range(len(sizes)):  # each block alone
        own = words[offsets[k] : offsets[k + 1]]
        assert np.array_equal(idfile.unpack_blocks(own, offsets[k : k + 2] - offsets[k], sizes[k : k + 1]), ids[k * block :][:block])


def test_words_hold_as_many_ids_as_fit():
    assert len(idfile.pack_blocks(np.ones(60, np.uint64))[0]) == 1
    assert len(idfile.pack_blocks(np.full(8, 2**15 - 1, np.uint64))[0]) == 2
    assert len(idfile.pack_blocks(np.array([2**60], np.uint64))[0]) == 2  # an escape and its value
    escapes = np.full(5, (1 << 64) - 1, np.uint64)  # values whose lowest bits look like an escape
    words, offsets = idfile.pack_blocks(escapes)
    assert np.array_equal(idfile.unpack_blocks(words, offsets, np.array([5])), escapes)


def test_damage_is_found():
    stream = io.BytesIO()
    writer = idfile.Writer(stream)
    writer.add(np.array([7]), np.array([3]), np.array([1, 2, 3]))
    writer.close()
    data = bytearray(stream.getvalue())

    class File(io.BytesIO):
        def size(self):
            return len(data)

    assert [x.tolist() for _, runs in idfile.Reader(File(bytes(data))).documents() for x in runs] == [[1, 2, 3]]
    data[-60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        idfile.Reader(File(bytes(data)))


def _plain(texts):
    library = Tokenizer.from_file(idfile.TOKENIZER)
    library.encode_special_tokens = True
    return [[*library.encode(t or "", add_special_tokens=False).ids, idfile.END_ID] for t in texts]


def test_files_hold_what_the_library_encodes(spark, folder):
    docs = table(spark, folder, "documents")
    manifest = idfile.write(docs, idfile.archive_folder(spark), file_ids=20_000, partitions=3)
    assert manifest.count() > 3  # several files in a partition
    rows = docs.orderBy("doc_id").collect()
    got = {r.key: r for r in idfile.read(manifest).collect()}
    start = 0
    for row, ids in zip(rows, _plain([r.text for r in rows]), strict=True):
        found = got.pop(row.doc_id)
        packed = np.array(ids, "<u4").tobytes()
        assert (found.start, found.n_tokens, bytes(found.ids)) == (start, len(ids), packed)
        assert found.ids_crc32 == zlib.crc32(packed)
        start += len(ids)
    assert not got


def test_defined_cases(spark, make, odd_texts):
    odd = [*odd_texts, (8, "a <|endoftext|> b")]
    rows = [(i, t, 1, "x", 2) for i, t in odd]
    docs = make(rows, "id long, body string, start int, key string, doc_id int")
    manifest = idfile.write(docs, idfile.archive_folder(spark), "id", "body")
    got = idfile.read(manifest).orderBy("start").collect()
    assert [r.key for r in got][1:] == sorted(i for i, _ in odd if i is not None)
    assert idfile.read(manifest).select(idfile.plain_key()).orderBy("key").first()[0] is None
    by_text = sorted(np.array(x, "<u4").tobytes() for x in _plain([t for _, t in odd]))
    assert sorted(bytes(r.ids) for r in got) == by_text
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    none = idfile.write(docs.limit(0), idfile.archive_folder(spark), "id", "body")
    assert none.count() == 0 and idfile.read(none).count() == 0
