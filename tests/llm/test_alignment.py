"""Alignment of two vocabularies against a plain search over whole texts, with the tokenizers themselves."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from millrace.llm import alignment, piececodes, shared
from tests.llm.test_packing import ODD, SF, _byte_level


def _plain(rows):
    """op12's rows by brute force: rows of (doc_id, text)."""
    import sentencepiece

    tok, model = _byte_level(False), sentencepiece.SentencePieceProcessor(model_file=piececodes.place(piececodes.PIECE_BPE))
    letters, found = piececodes._byte_letters(), []
    for doc, text in rows:
        a, b, full = [], [], b" " + (text or "").encode()
        if text:
            a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            names = [(i, model.id_to_piece(i)) for i in model.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == full:
                a, b = [], []
        ranges = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            ranges.append(out)
        links, j0 = [], 0
        for s, e, i in ranges[0]:
            while ranges[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ranges[1]) and ranges[1][j][0] < e:
                links.append((i, ranges[1][j][2]))
                j += 1
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups = [[[], []] for _ in ends]
        for side in (0, 1):
            k = 0
            for _, e, i in ranges[side]:
                groups[k][side].append(str(i))
                k += e == ends[k]
        written = ";".join("|".join(",".join(x) for x in g) for g in groups)
        found.append((doc, len(a), len(b), len(ends), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    docs = Counter(p for x in found for p in set(x[4]))
    top: dict = {}
    for (i, _), n in docs.items():
        top[i] = max(n, top.get(i, 0))
    return sorted((d, na, nb, g, len(ls), sum(docs[p] == top[p[0]] for p in ls), sum(docs[p] for p in ls), h) for d, na, nb, g, ls, h in found)


def _rows(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_op12_is_what_a_plain_search_finds(spark):
    docs = [(r.doc_id, r.text) for r in shared.table(spark, SF, "documents").collect()]
    out = alignment.op12(spark, SF)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", "string")]
    assert _rows(out) == _plain(docs)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return str(tmp_path_factory.mktemp("odd")), [(k, t) for k, t in enumerate([None, *ODD, "same same", "same same", "café one, two\n\nthree " * 3000])]


@pytest.mark.parametrize("most", [64, alignment.PART_BYTES])
def test_op12_edges_in_parts_or_whole(spark, odd, most, monkeypatch, tmp_path):
    _, rows = odd
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, pairs string, _row int").write.parquet(f"{folder}/documents.parquet")
    plain = alignment.alignment
    monkeypatch.setattr(alignment, "alignment", lambda text, a, b: plain(text, a, b, most))
    assert _rows(alignment.op12(spark, folder)) == _plain(rows)


def test_blocks_give_the_same_sums(spark):
    aligned = shared.written(alignment.align(shared.table(spark, SF, "documents")), "aligned")
    pairs = alignment.pair_documents(aligned, 32000)
    whole, parts = alignment.scored(aligned, pairs), alignment.scored(aligned, pairs, block_pairs=3000)
    key = ["doc_id", "n_best", "count_sum", "lang"]
    assert sorted(whole.select(key).collect()) == sorted(parts.select(key).collect())
    assert whole.columns == parts.columns


def test_align_keeps_columns_repeats_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None)], "doc_id long, text string, groups string, `_ma.de` string")
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "text", "_ma.de", *alignment.FIELDS]
    assert sorted((r.doc_id or 0, r.n_a, r.groups) for r in got.collect()) == [(0, 0, ""), (1, 2, "257|264;275|287"), (1, 2, "257|264;275|287")]
    pairs = alignment.pair_documents(got, 32000).collect()
    assert sorted((r.a, r.b, r.n_docs, r.best) for r in pairs) == [(257, 264, 2, True), (275, 287, 2, True)]
    none = shared.written(alignment.align(docs.limit(0)), "none")
    assert alignment.scored(none, alignment.pair_documents(none, 32000)).count() == 0
