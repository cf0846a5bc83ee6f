"""Cross-tokenizer alignment against plain loops over the libraries' own encodings."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stakewell.llm import align, tokens

from .test_operators import DOC, LONG, docs_of, odd_docs

A, B = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
STRANGE = ["<|endoftext|> and <s>", "a▁b", "  two  spaces ", " ", "tabs\t\tand\n\n  lines \r\n x\n ", "né 日本語 🙂🙂 é", "\x00\x1c\x1f \x85", "ﬁ ½ ﻿x ​", "'s 'T don't I'LL 12345", "a" * 5000, " " * 300 + "x" + " " * 300, "日" * 3000]


def plain(texts):
    """(ids of A, ids of B, groups) of each text, from whole encodings by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = align._letters()
    name = {i: w for w, i in t.get_vocab(with_added_tokens=False).items()}
    out = []
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        of_a = [bytes(byte[c] for c in name[i]) for i in a]
        of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            out.append(([], [], []))
            continue
        groups, i, j, at_a, at_b = [[[], []]], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                groups[-1][0].append(a[i])
                at_a, i = at_a + len(of_a[i]), i + 1
            else:
                groups[-1][1].append(b[j])
                at_b, j = at_b + len(of_b[j]), j + 1
            if at_a == at_b:
                groups.append([[], []])
        out.append((a, b, groups[:-1]))
    return out


def truth(rows):
    found = plain([t or "" for _, t in rows])
    count = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (doc_id, _), (a, b, groups) in zip(rows, found, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in align.alignment(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment_like_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).select("doc_id", "text").collect()]
    assert result(docs_of(spark)) == truth(rows)


@pytest.mark.parametrize("run, step", [(align.RUN, align.STEP), (7, 64)])
def test_alignment_odd_rows(spark, monkeypatch, run, step):
    """Special names in texts, spaces, other scripts, copies, nulls; with short runs and steps documents go on over many of them."""
    monkeypatch.setattr(align, "RUN", run)
    monkeypatch.setattr(align, "STEP", step)
    docs = odd_docs(spark)
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.unionByName(docs.where(F.col("doc_id").isNull() | (F.col("doc_id") % 3 == 0)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == truth(rows)
    assert result(spark.createDataFrame([], DOC)) == []


def test_groups_hold_the_bytes(spark):
    docs = spark.createDataFrame([(1, "Grüße, 世界! don't"), (2, LONG), (3, ""), (None, "x y"), (None, "x y")], "doc_id long, text string")
    rows = align.groups(docs, A, B).orderBy("doc_id", "number").collect()
    a, b = align.ByteLevel(A), align.Pieces(B)
    for doc_id, text in ((1, "Grüße, 世界! don't"), (2, LONG), (None, "x y")):
        mine = [r for r in rows if r.doc_id == doc_id]
        whole = (" " + text).encode()
        assert [r.number for r in mine] == list(range(len(mine))) and mine[0].first_byte == 0 and mine[-1].end_byte == len(whole)
        for r in mine:
            for words, ids in ((a, r.a_ids), (b, r.b_ids)):
                assert b"".join(words.entries[i] for i in ids) == whole[r.first_byte : r.end_byte]
    assert {r.copies for r in rows if r.doc_id is None} == {2}


def test_chunks_and_ranks_equal_the_libraries(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + STRANGE
    mine = [align.ByteLevel(A).encode(texts), align.Pieces(B).encode(texts)]
    for (a, b, _), x, y in zip(plain(texts), *mine, strict=True):
        if a:
            assert x.tolist() == a and y.tolist() == b
        else:
            assert x is None or y is None or not len(a)


def test_a_model_without_ranks_goes_by_the_library(tmp_path):
    import json

    spec = json.load(open(A))
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    words = align.ByteLevel(str(tmp_path / "other.json"))
    assert b"".join(words.entries[i] for i in words.encode(["the <|endoftext|> x"])[0]) == b" the <|endoftext|> x"
