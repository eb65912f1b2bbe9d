"""Encoding, packing and token files against the tokenizers library."""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frostline.llm import bpe, encoding, packing, shared, tokenfile
from frostline.llm.queries import TOKENIZER, op5_best_fit_packing, op6_bpe, op8_token_files

LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids_of(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def held(table: bpe.PieceTable, text: str) -> list[int]:
    return np.frombuffer(table.ids(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst aab'\n \t\r0½²ªµé\xa0\x85 　日<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoders_equal_the_library(text: str) -> None:
    want = ids_of(text)
    assert held(bpe.own_encoder(TOKENIZER), text) == want
    assert held(bpe.library_encoder(TOKENIZER), text) == want
    assert bpe.vocabulary(TOKENIZER).decode(np.array(want, np.int64)) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 3000, "a" * 5001, " " * 777, "=" * 999, "thethethe" * 200, "<|endoftext|>", "x<|endoftext|> \n<|endoftext|>  y", "日本語" * 300])
def test_long_pieces(text: str) -> None:
    assert held(bpe.own_encoder(TOKENIZER), text) == ids_of(text)


def test_each_token_encodes_to_itself() -> None:
    v = bpe.vocabulary(TOKENIZER)
    for i in range(0, 50_256, 7):
        b = v.decode_bytes(np.array([i]))
        if v.offsets[i + 1] - v.offsets[i] and b.decode("utf-8", "ignore").encode() == b and len(bpe.pieces(b.decode())) == 1:
            assert v.encode_piece(b.decode()) == ids_of(b.decode())


def test_invalid_bytes_decode_as_the_library_does() -> None:
    for ids in ([220, 255, 130], [50_256, 188], [161, 222, 0], []):
        assert bpe.vocabulary(TOKENIZER).decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_op6(spark, clean_dir: str, clean_rows: list[tuple]) -> None:  # noqa: ANN001
    got = {r.doc_id: r for r in op6_bpe(spark, clean_dir).collect()}
    assert len(got) == len(clean_rows)
    for doc, text, _ in clean_rows:
        ids = ids_of(text)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_and_decode_of_messy_rows(messy, empty) -> None:  # noqa: ANN001
    back = encoding.decode(encoding.encode(messy, TOKENIZER), TOKENIZER)
    shown = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
    assert shown(back.collect()) == shown(messy.collect())
    assert encoding.encode(empty, TOKENIZER).collect() == [] and encoding.round_trip(empty, TOKENIZER).collect() == []


def one_by_one(lengths: list[int], capacity: int) -> int:
    """Bins of plain best fit decreasing."""
    rooms, n = [], 0
    for size in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms.pop(k) - size
        else:
            n, room = n + 1, capacity - size
        if room:
            bisect.insort(rooms, room)
    return n


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=120))
def test_runs_are_best_fit_decreasing(capacity: int, lengths: list[int]) -> None:
    lengths = [n for n in lengths if n <= capacity]
    counts = {k: lengths.count(k) for k in set(lengths)}
    space: dict[int, list[tuple[int, int]]] = {}
    for length, low, high, first, each, offset in packing.best_fit_decreasing(counts, capacity):
        for r in range(low, high):
            space.setdefault(first + (r - low) // each, []).append((offset + (r - low) % each * length, length))
    assert len(space) == one_by_one(lengths, capacity)
    for parts in space.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, space.values())) == len(lengths)


def check_packing(rows: list, want: list[tuple], capacity: int) -> None:
    of_doc: dict[object, list] = {}
    sequences: dict[int, list] = {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want:
        parts, at = sorted(of_doc[doc], key=lambda r: r.piece), 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == one_by_one([r.length for r in rows], capacity)


def test_op5(spark, clean_dir: str, clean_rows: list[tuple]) -> None:  # noqa: ANN001
    check_packing(op5_best_fit_packing(spark, clean_dir).collect(), [(d, [*ids_of(t), 0]) for d, t, _ in clean_rows], 2048)


def test_packing_of_messy_rows(messy, empty, spark) -> None:  # noqa: ANN001
    rows = packing.pack_documents(messy, TOKENIZER, capacity=300).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text or "")) + 1 for r in messy.collect())
    assert packing.pack_documents(empty, TOKENIZER).collect() == []
    same = spark.createDataFrame([(1, "a b")] * 700, "doc_id bigint, text string")
    packed = packing.pack_documents(same, TOKENIZER, capacity=7).collect()
    assert len(packed) == 700 and len({(r.sequence_id, r.offset) for r in packed}) == 700 and len({r.sequence_id for r in packed}) == 350


def test_op8(spark, clean_dir: str, clean_rows: list[tuple]) -> None:  # noqa: ANN001
    got, at = {r.doc_id: r for r in op8_token_files(spark, clean_dir).collect()}, 0
    for doc, text, _ in clean_rows:
        ids = np.array([*ids_of(text), 2], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(clean_rows)


def test_token_files(spark, messy, empty) -> None:  # noqa: ANN001
    manifest = tokenfile.write(messy, shared.new_path(spark, "files"), TOKENIZER)
    rows = tokenfile.read(spark, manifest).orderBy("start").collect()
    assert len(rows) == messy.count() and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    wanted = {5: None, 84: None, 4711: None}
    found = {r.doc_id: r.ids for r in tokenfile.find(spark, manifest, spark.createDataFrame([(k,) for k in wanted], "doc_id bigint")).collect()}
    texts = {r.doc_id: r.text for r in messy.collect()}
    assert found == {k: [*ids_of(texts[k]), 2] for k in (5, 84)}
    assert tokenfile.read(spark, tokenfile.write(empty, shared.new_path(spark, "files"), TOKENIZER)).collect() == []


def test_small_token_files_share_tasks(spark, clean, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    """The tasks that encode write no manifest of their own, and reading takes as many tasks as the ids need."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokenfile.write(clean, shared.new_path(spark, "files"), TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.inputFiles()) == 1 and files.count() > 1
    many, parts = files, spark.sparkContext.defaultParallelism
    for _ in range(4):
        many = many.union(many)
    assert many.count() > parts
    rows = tokenfile.read(spark, many)
    assert rows.rdd.getNumPartitions() == parts and rows.count() == 16 * clean.count()
    monkeypatch.setattr(tokenfile, "IDS_OF_A_TASK", 1)
    assert tokenfile.read(spark, many).rdd.getNumPartitions() == many.count()


def test_any_number_of_documents_is_found(spark) -> None:  # noqa: ANN001
    """More ids than any list on the driver should hold, repeated, null and unknown ones among them."""
    docs = spark.range(0, 3000, 3).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs = docs.union(spark.createDataFrame([(9, "again"), (None, "no id")] + [(12, f"hot {k}") for k in range(500)], "doc_id bigint, text string"))
    manifest = tokenfile.write(docs, shared.new_path(spark, "files"), TOKENIZER)
    asked = spark.range(-1000, 150_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 9 ELSE id END AS `an id`")
    wanted = {r[0] for r in asked.collect()}
    got = sorted((r.doc_id, r.ids) for r in tokenfile.find(spark, manifest, asked).collect())
    assert got == sorted((r.doc_id, [*ids_of(r.text), 2]) for r in docs.collect() if r.doc_id in wanted and r.doc_id is not None)


def test_pieces_of_one_id_are_several_tasks(spark) -> None:  # noqa: ANN001
    """A third of the rows have one id, a third none: ranks within a length come from salted groups all the same."""
    docs = spark.createDataFrame([(5 if k % 3 else None, f"a b {k % 4}") for k in range(900)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, TOKENIZER, capacity=20).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 900 and len({r.sequence_id for r in rows}) == 180
    pieces = packing.cut(docs, TOKENIZER, 20, 0).withColumn("number", F.monotonically_increasing_id()).cache()
    plan = packing.pack(pieces, 20)._jdf.queryExecution().toString()
    assert "xxhash64(number" in plan


def test_file_is_plain_zstandard_and_damage_is_found(tmp_path) -> None:  # noqa: ANN001
    path = str(tmp_path / "t.zst")
    fs = pyarrow.fs.LocalFileSystem()
    writer = tokenfile.TokenFileWriter(fs.open_output_stream(path, compression=None))
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 2000)]
    for k, p in enumerate(parts):
        writer.add(k, p)
    writer.close()
    data = (tmp_path / "t.zst").read_bytes()
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)[:12] == parts[0]
    reader = tokenfile.TokenFileReader(fs.open_input_file(path))
    assert [reader.ids(k) for k in range(3)] == parts and [(d, len(i)) for d, i in reader.find([2, 9])] == [(2, 2000)]
    hurt = bytearray(data)
    hurt[len(writer.entries) and int(reader.begins[2]) + 20] ^= 0xFF
    (tmp_path / "h.zst").write_bytes(hurt)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.TokenFileReader(fs.open_input_file(str(tmp_path / "h.zst"))).ids(2)
    (tmp_path / "n.zst").write_bytes(b"0" * 40)
    with pytest.raises(ValueError, match="seek table"):
        tokenfile.TokenFileReader(fs.open_input_file(str(tmp_path / "n.zst")))
