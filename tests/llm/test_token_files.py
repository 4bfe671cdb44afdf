from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from molspark.llm import queries, token_files
from molspark.staging import fresh_path
from tests.llm.helpers import FOLDER, SCHEMA, rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("width", [1, 2, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(width):
    rnd = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000, 4096):
        ids = rnd.integers(0, 1 << width, n, dtype=np.uint64)
        packed = token_files.pack(ids, width)
        assert len(packed) == -(-n * width // 8)
        bits = "".join(format(int(i), f"0{width}b")[::-1] for i in ids)
        assert packed == bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
        assert token_files.unpack(packed, width, n).tolist() == ids.tolist()


def test_width_is_the_least():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_encoder_cuts_only_where_the_pattern_does(tokenizer):
    rnd, encoder = random.Random(3), token_files.Encoder(PATH)
    bits = [" ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "a", "Bc", "'s", "'", "12", "é", "中文", "!", "...", "<|endoftext|>", "\r\n", "x" * 50]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(3000)] + ["", " ", "\n", " a", "\na", "a ", "a\n"]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, got in zip(some, encoder(some)):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PARTS", 5)
    encoder = token_files.Encoder(PATH)
    for text in [r[1] or "" for r in rows()] * 2:
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder._known) <= 5 + len(text.replace("\n", " \n").split(" "))


def test_round_trip_against_the_library(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "SPLIT_IDS", 20_000)
    data = rows()
    folder = fresh_path(spark, "ids")
    token_files.write_ids(table(spark, data), folder)
    got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
    expected = sorted(((r[0], whole(tokenizer, r[1])) for r in data), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == expected
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))  # nulls first
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    stream = np.frombuffer(b"".join(r.ids for r in got), "<u4")
    known = token_files.manifest(folder)
    assert known["ids"] == at and known["width"] == 16
    for begin, end in ((0, 0), (0, 10), (7, 70), (at // 3, at // 2), (at - 5, at + 5)):
        assert token_files.read_range(folder, begin, end).tolist() == stream[begin:end].tolist()
    for length in (64, 1000):
        windows = {r.window: np.frombuffer(r.ids, "<u4") for r in token_files.read_windows(spark, folder, length).collect()}
        assert sorted(windows) == list(range(at // length))
        for k, ids in windows.items():
            assert ids.tolist() == stream[k * length : (k + 1) * length].tolist()


def test_ids_of_one_document_span_blocks(spark, tokenizer):
    text = " ".join(map(str, range(60_000)))
    folder = fresh_path(spark, "ids")
    token_files.write_ids(spark.createDataFrame([(1, "a"), (2, text), (3, None)], "doc_id long, text string"), folder)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(spark, folder).collect()}
    assert len(got[2]) > token_files.BLOCK and got == {1: whole(tokenizer, "a"), 2: whole(tokenizer, text), 3: [0]}


def test_hot_id_is_dealt_over_tasks(spark):
    data = [(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(20)]
    folder = fresh_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_ids(spark.createDataFrame(data, "doc_id long, text string"), folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [f["documents"] for f in token_files.manifest(folder)["files"]]
    assert sum(sizes) == 320 and max(sizes) < 300


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.round_trip(empty).collect() == []


def test_query_against_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op13_packed_token_files"](spark, FOLDER).collect()}
    at = 0
    for r in docs:
        ids = np.array(whole(tokenizer, r.text), "<u4")
        assert got.pop(r.doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got
