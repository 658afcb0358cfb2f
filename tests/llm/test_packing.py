import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens

PATH = tokens.default_path()
LIB = Tokenizer.from_file(PATH)


def lib_ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_library(text):
    assert tokens.encoder(PATH).encode(text).tolist() == lib_ids(text)


def test_encoder_takes_the_fast_way_and_special_tokens():
    e = tokens.encoder(PATH)
    assert e.fast is not None
    for text in ("a<|endoftext|>b <|endoftext|>", "<|endoftext", "  x\n\n\ty's '", "é ñ ß 12３"):
        assert e.encode(text).tolist() == lib_ids(text)


def test_settled_characters_split_alike():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not tokens._SETTLED.search(chr(c))]
    e = tokens.encoder(PATH)
    for at in range(0, len(chars), 500):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in chars[at : at + 500])
        assert e._quick(text).tolist() == lib_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan_is_whole_and_gapless(counts):
    plan, used = packing.plan_best_fit(counts, 64)
    held, ranks = defaultdict(list), Counter()
    for p in plan:
        assert p.first == ranks[p.length]
        ranks[p.length] = p.end
        for q in range(p.end - p.first):
            held[p.sequence + q // p.per].append((p.offset + q % p.per * p.length, p.length))
    assert ranks == Counter(counts)
    assert sorted(held) == list(range(used))
    for parts in held.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    # what best-fit decreasing does piece by piece
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= n
        else:
            rooms.append(64 - n)
    assert used == len(rooms)


def test_cut():
    assert packing.cut(np.zeros(5), 4) == [(0, 1), (1, 4)]
    assert packing.cut(np.zeros(8), 4) == [(0, 4), (4, 4)]
    assert packing.cut(np.zeros(4), 4) == [(0, 4)]


@pytest.mark.parametrize("ranked", [200_000, 3])
def test_pack_round_trip(spark, ranked, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", ranked)
    monkeypatch.setattr(packing.assign_slots, "__defaults__", (packing.CAPACITY, ranked))
    texts = ["one two three"] * 9 + [None, "", "long text " * 3000, "a<|endoftext|>b", "é" * 700, "one two three"]
    rows = [(i, t, 7, 7) for i, t in enumerate(texts)] + [(None, "no id", 1, 1), (3, "one two three", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, d int")
    packed = packing.pack_documents(docs, PATH, with_ids=True)
    got = packed.collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d in {r[0] for r in rows}:
        want = sorted(tuple(lib_ids(r[1] or "") + [0]) for r in rows if r[0] == d)
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        if len(want) == 1:
            ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in parts])
            assert tuple(ids.tolist()) == want[0]
            assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
            assert all(r.length == 2048 for r in parts[1:])
        else:
            assert len(parts) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in parts)
    seqs = packing.packed_sequences(packed).collect()
    assert all(s.n_tokens * 4 == len(s.ids) <= 2048 * 4 for s in seqs)
    assert sum(s.n_tokens for s in seqs) == sum(r.length for r in got)
    for s in seqs:
        end = 0
        for r in sorted((r for r in got if r.sequence_id == s.sequence_id), key=lambda r: r.offset):
            assert r.offset == end and bytes(s.ids)[4 * end : 4 * (end + r.length)] == bytes(r.ids)
            end += r.length
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
