"""Packing and the encoder that it shares with the alignment, against the tokenizers themselves on whole texts."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, piececodes, shared

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "a", "word " * 3, "a  <|endoftext|> b <|endoftext|>", "<|endoftext|>", "  x 　 y  z", "a \n b\t c ", "don't  can't 123 4  ", "▁ a ▁▁b", "<s> a </s> <unk> <0x41>",
    "café \U0001f600 \x00 z", "  x  y   z \u0085 w", "x, y. (z) a-b 'tis we'll", "   lead", "trail   ", "no_spaces_" * 400, "中文 文字 　中", "a​b ​ c", " ,;: .,", "\r\n \r\n x",
]


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _texts(spark, sf):
    return [r[0] or "" for r in shared.table(spark, sf, "documents").select("text").collect()] + ODD


def _byte_level(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(piececodes.place(piececodes.BYTE_BPE))
    t.encode_special_tokens = not special
    return t


@pytest.mark.parametrize("special", [True, False])
def test_codes_are_those_of_whole_texts(spark, special):
    texts = _texts(spark, SF)
    ids, at, same = piececodes.byte_level(special=special).codes(*_bytes(texts))
    want = [x.ids for x in _byte_level(special).encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want
    assert same.all()


def test_pieces_of_the_other_vocabulary_are_those_of_whole_texts(spark):
    import sentencepiece

    texts = [t for t in _texts(spark, SF) if t]
    model = sentencepiece.SentencePieceProcessor(model_file=piececodes.place(piececodes.PIECE_BPE))
    ids, at, same = piececodes.piece_level().codes(*_bytes([" " + t for t in texts]))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == model.encode(texts)
    assert [t for t, ok in zip(texts, same) if not ok] == [t for t in texts if "▁" in t]


def test_a_worker_that_forgets_gives_the_same(monkeypatch):
    codes, texts = piececodes.piece_level.__wrapped__(), [" " + t for t in ODD if t]
    want = [x.tolist() for x in codes.codes(*_bytes(texts))]
    monkeypatch.setattr(piececodes, "MOST_PIECES", 1)
    for _ in range(3):
        assert [x.tolist() for x in codes.codes(*_bytes(texts))] == want
    assert len(codes.number) < 200


def test_a_vocabulary_of_another_order_is_left_to_tokenizers(tmp_path):
    import json

    whole = json.loads(open(piececodes.place(piececodes.BYTE_BPE), encoding="utf-8").read())
    a, b = [x if isinstance(x, str) else "".join(x) for x in whole["model"]["merges"][5:7]]
    vocab, path = whole["model"]["vocab"], str(tmp_path / "swapped.json")
    a, b = a.replace(" ", ""), b.replace(" ", "")
    vocab[a], vocab[b] = vocab[b], vocab[a]
    (tmp_path / "swapped.json").write_text(json.dumps(whole), encoding="utf-8")
    ids, at, _ = piececodes.byte_level(path).codes(*_bytes(ODD))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]


def test_cut_is_the_binary_form_of_a_length():
    lengths = np.array([1, 2, 3, 7, 8, 9, 16, 29])
    many, got = packing.cut(lengths, 8)
    at = np.concatenate([[0], np.cumsum(many)])
    mine = [got[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    assert mine == [[1], [2], [2, 1], [4, 2, 1], [8], [8, 1], [8, 8], [8, 8, 8, 4, 1]]
    with pytest.raises(ValueError):
        packing.pieces(F.col("text"), 12)


def _check(rows, texts):
    """rows: of op11; texts: by doc_id, each once."""
    tok, own = _byte_level(True), {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    assert set(own) == set(texts)
    for k, t in texts.items():
        ids, end = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (end, len(ids), 0)
            assert r.length <= 2048 and r.length & (r.length - 1) == 0
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            end += r.length
        assert end == len(ids)
        assert len({r.length for r in own[k] if r.length < 2048}) == sum(r.length < 2048 for r in own[k])
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_op11_packs_every_document(spark):
    docs = shared.table(spark, SF, "documents").collect()
    _check(packing.op11(spark, SF).collect(), {r.doc_id: r.text for r in docs})


def test_op11_edges(spark, tmp_path):
    long = "one two three, four " * 60_000
    rows = [(k, t, "x", "y") for k, t in enumerate([None, *ODD, long])]
    spark.createDataFrame(rows, "doc_id long, text string, _made string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    _check(packing.op11(spark, str(tmp_path)).collect(), {r[0]: r[1] for r in rows})


def test_sequences_keep_columns_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "p"), (None, "a b", 1, "p"), (3, None, None, None)], "doc_id long, text string, length long, `od.d` string")
    out = packing.sequences(docs)
    assert out.columns == ["doc_id", "od.d", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
    got = sorted(((r.doc_id, r["od.d"], r.start, r.ids) for r in out.withColumn("ids", packing.as_array(F.col("ids"))).collect()), key=str)
    assert got == [(3, None, 0, [1]), (None, "p", 0, [64, 275]), (None, "p", 0, [64, 275]), (None, "p", 2, [1]), (None, "p", 2, [1])]
    assert packing.bucketed(packing.sequences(docs.limit(0))).count() == 0


def test_buckets_and_batches(spark):
    packed = packing.bucketed(packing.sequences(shared.table(spark, SF, "documents")))
    assert packed.filter(F.octet_length("ids") != 2 * F.col("length")).count() == 0
    assert packed.filter("length = 64").inputFiles() and all("length=" in f for f in packed.inputFiles())
    got = packing.batches(packed, 4096, seed=3).toPandas()
    assert len(got) == packed.count() and got.sequence_id.is_unique
    for length, own in got.groupby("length"):
        many = max(1, 4096 // length)
        sizes = own.groupby("batch").size()
        assert (sizes.iloc[:-1] == many).all() and sizes.index.tolist() == list(range(-(-len(own) // many)))
        assert own.sort_values(["batch", "slot"]).slot.tolist() == [k % many for k in range(len(own))]
