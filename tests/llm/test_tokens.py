"""Pieces, wavelet matrices, token files and edit-aware counts against the tokenizer and brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from opslens.llm import pieces, token_files
from opslens.llm.edit_counts import CountTree, count_edited, tokens_of
from opslens.llm.pieces import PieceEncoder, encoder
from opslens.llm.queries import vocabulary as path
from opslens.llm.wavelet import WaveletMatrix

TOKENIZER = Tokenizer.from_file(path())
TOKENIZER.encode_special_tokens = True
PLAIN = Tokenizer.from_file(path())  # as the library reads it: added tokens have ids of their own
LETTERS = st.lists(st.sampled_from([*"ab .,'\n\tre1é\xa0\x00\x1c 　日", "<|endoftext|>", "<|", "endoftext|>"]), max_size=40).map("".join)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    found = list(encoder(path()).encode(pa.array(texts, pa.string())))
    ids = [i for x, _ in found for i in x.tolist()]
    plain = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == [i for x in plain for i in x]
    sizes, held = [], 0
    for x, counts in found:
        for n in counts.tolist():
            held += len(x) if n < 0 else n
            if n >= 0:
                sizes.append(held)
                held = 0
    assert sizes == [len(x) for x in plain]


@pytest.mark.parametrize("text", ["foo., bar", "x.\ny", "<|endoftext|> a", "  ", " a ", "it's 'r 're", "1.5, 2.", "a\r\nb", "a \n b"])
def test_pieces_of_chosen_texts(text):
    assert np.concatenate([x for x, _ in encoder(path()).encode(pa.array([text]))]).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_long_texts_come_in_parts_and_forgotten_pieces_are_learned_again(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 200)
    monkeypatch.setattr(pieces, "KEPT", 50)
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    own = PieceEncoder(path())
    ids = [i for x, _ in own.encode(pa.array([long, "a", long])) for i in x.tolist()]
    assert ids == ids_of(long) + ids_of("a") + ids_of(long)
    assert sum(int(c.sum()) for c, _ in own.measure(pa.array([long]))) == len(long)
    assert sum(int(n.sum()) for _, n in own.measure(pa.array([long]))) == len(ids_of(long))


def test_frequent_pieces_stay_and_long_ones_go(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 500)
    monkeypatch.setattr(pieces, "KEPT", 200)
    rng = random.Random(2)
    own = PieceEncoder(path())
    for i in range(60):
        text = " ".join(f"of{k} w{rng.randrange(10**6)}" for k in range(30))
        odd = f"a\xa0whole text {i} " * 100  # one piece
        assert [x for ids, _ in own.encode(pa.array([text, odd])) for x in ids.tolist()] == ids_of(text) + ids_of(odd)
        assert sum(map(len, own._numbers)) < 200 * 16 + 2 * len(odd) and len(own._numbers) < 200 + 2 * 60
        assert i < 2 or all(f"of{k}" in own._numbers for k in range(1, 30))


def test_a_word_is_encoded_once_whatever_marks_stand_behind_it(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 300)
    own, words, seen = PieceEncoder(path()), [f"w{i}" for i in range(40)], []
    whole = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda texts: seen.extend(texts) or whole(texts))
    texts = [" ".join(f"{w}{mark}" for w in words) for mark in ("", ";", ")", "!?", "\"", ":", "...", "$$$")]
    ids = [x for found, _ in own.encode(pa.array(texts)) for x in found.tolist()]
    assert ids == [x for t in texts for x in ids_of(t)]
    assert sum(map(len, seen)) < 2.5 * len(texts[0])


def test_pieces_of_many_portions_are_looked_up_together(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 100)
    own, rounds = PieceEncoder(path()), []
    numbered = own._numbered
    monkeypatch.setattr(own, "_numbered", lambda *args, **more: rounds.append(1) or numbered(*args, **more))
    texts = [f"one two three {i} and more words of it{chr(160) * (i % 2)}." for i in range(100)]
    assert [x for found, _ in own.encode(pa.array(texts)) for x in found.tolist()] == [x for t in texts for x in ids_of(t)]
    assert len(rounds) <= 4


@pytest.mark.parametrize("chunk", [5, 30, 1_000])
def test_texts_with_added_tokens_over_many_portions(monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    end = "<|endoftext|>"
    texts = ["some words", f"{end}a b c{end}{end}more words here", "", end, f"a long text of words {end} and words {end}", None, "x"]
    held, found = [], []
    for ids, counts in PieceEncoder(path()).encode(pa.array(texts)):
        for n in counts.tolist():
            held += ids.tolist() if n < 0 else ids[:n].tolist()
            ids = ids[max(n, 0) :]
            if n >= 0:
                found.append(held)
                held = []
    assert found == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts] and not held


def test_a_portion_and_a_shard_read_back_take_little_memory():
    rng = np.random.default_rng(1)
    own, words = PieceEncoder(path()), np.array([f"word{i}" for i in range(5_000)])
    texts = pa.array([" ".join(words[rng.integers(0, 5_000, 500)]) for _ in range(2_000)])
    tracemalloc.start()
    for _ in own.encode(texts):
        pass
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    n = 2_000_000
    row = token_files._row(0, [rng.integers(0, 50_000, n).astype(np.uint16)], [1, None], [n // 2, n - n // 2])
    tracemalloc.start()
    held = list(token_files._documents(iter([row])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n and held[0].column("doc_id").to_pylist() == [1, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(0, 70_000))
def test_wavelet_matrix(ids, other):
    ids = np.array(ids, np.uint32)
    held = WaveletMatrix.build(ids)
    assert held.decode().tolist() == ids.tolist()
    for token in {*ids[:5].tolist(), other}:
        places = np.flatnonzero(ids == token).tolist()
        assert held.occurrences(token).tolist() == places
        assert held.select(token, len(places)) == -1
        assert held.count(token, len(ids) // 3, len(ids) // 2) == int((ids[len(ids) // 3 : len(ids) // 2] == token).sum())
    assert [held.access(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_token_files(spark, odd, nothing, vocabulary, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write(odd, folder, vocabulary, shard_ids=20)
    shards = token_files.files(spark, folder).cache()
    rows = sorted(token_files.documents(shards).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.select("doc_id", "text").collect()))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [x[:2] for x in texts]
    start, stream = 0, []
    for r, (_, _, text) in zip(rows, texts, strict=True):
        ids = ids_of(text) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    assert shards.count() > 1
    token = ids_of(" word")[0]
    assert token_files.counts(shards, [token, 0]).orderBy("token").collect()[1].n == stream.count(token)
    found = sorted((r.shard, r.place) for r in token_files.occurrences(shards, [0]).collect())
    held = [token_files.matrix(r.asDict()).decode().tolist() for r in shards.orderBy("shard").collect()]
    assert len(found) == len(texts) and [i for h in held for i in h] == stream
    empty = str(tmp_path / "none")
    token_files.write(nothing, empty, vocabulary)
    assert token_files.documents(token_files.files(spark, empty)).count() == 0


@settings(max_examples=80, deadline=None)
@given(LETTERS, LETTERS, st.lists(st.tuples(st.integers(-2, 150), st.integers(-2, 150), LETTERS), max_size=6))
def test_counts_follow_edits(head, middle, edits):
    text = head + " some words stand here, " + middle + "\nand more of them at the end of it." * 3
    own = encoder(path())
    (chars, ids), = own.measure(pa.array([text]))
    tree = CountTree(text, chars, ids, own)
    assert tree.n_ids == len(ids_of(text))
    for start, end, new in edits:
        a = min(max(start, 0), len(text))
        text = text[:a] + new + text[min(max(end, a), len(text)) :]
        tree.edit(start, end, new)
        assert (tree.text, tree.n_ids, int(tree.sums[1, 0])) == (text, len(ids_of(text)), len(text))


def test_an_edit_encodes_a_small_region_only():
    text = " ".join(f"word{i}" for i in range(20_000))
    own = encoder(path())
    (chars, ids), = own.measure(pa.array([text]))
    tree = CountTree(text, chars, ids, own)
    tree.edit(70_000, 70_010, "other")
    assert tree.encoded < 2_000 and tree.n_ids == len(ids_of(tree.text))
    tree.edit(100, 110, " ".join(f"more{i}" for i in range(3_000)))
    assert tree.n_ids == len(ids_of(tree.text)) and tree.leaves > 20_000 // 32


def test_counted_documents(odd, nothing, vocabulary):
    edits = "array(named_struct('start', 2L, 'end', 5L, 'replacement', ' new\n'), cast(null as struct<start:long,end:long,replacement:string>), named_struct('start', 1000000L, 'end', null, 'replacement', null))"
    rows = count_edited(odd.drop("edits").selectExpr("*", f"if(doc_id = 5, null, {edits}) as edits"), vocabulary, keep=("doc_id", "text", "n_chars")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r.text or ""
        after = text if r.doc_id == 5 else text[:2] + " new\n" + text[5:]
        assert (r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) == (len(text), len(ids_of(text)), len(after), len(ids_of(after)))
    assert tokens_of(nothing, vocabulary).count() == 0
