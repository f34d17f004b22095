from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from palimpsest.llm import packing as op

from .helpers import ODD, clashing, docs, prose


def test_ids_are_the_tokenizers_own():
    odd = [t for t in ODD if t is not None and len(t) < 1000]
    odd += ["<|endoftext|>x <|startoftext|> y<|ENDOFTEXT|>", "H̱ x̱  ́a", "don't we'll 's 12 ...,,a.b", "\x1c\x1da b　c", "  ", "́ ́x", "ΣΑΣ İ"]
    known = op.Ids(op.TOKENIZER)
    for text, raw in zip(odd, known.of(odd), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_letters_are_told_apart_by_their_ends():
    plain = prose(3, 60) + " Straße ñü ǅ ﬁ ʰa 漢字 x&&& a.b don't 12 x̀y"
    # a letter whose small form is not all letters makes two words of one: offsets tell
    for text, by_ends in ((plain, True), (plain + " İstanbul", False)):
        known, by_offsets = op.Ids(op.TOKENIZER), []
        learn = known._learn
        known._learn = lambda stretches, learn=learn, seen=by_offsets: seen.extend(stretches) or learn(stretches)
        assert np.frombuffer(known.of([text])[0], "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
        assert any(w.isalpha() for w in by_offsets) != by_ends


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 200)
    known = op.Ids(op.TOKENIZER)
    texts = [prose(i, 40) for i in range(12)]
    for text in texts + texts:
        assert np.frombuffer(known.of([text])[0], "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(known.now) + len(known.before) < 200


def plain_best_fit(sizes, window):
    room, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            k = room.index(min(fits))
        else:
            room.append(window)
            k = len(room) - 1
        where[i] = room[k]
        room[k] -= sizes[i]
    return len(room), where


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_as_a_plain_search(seed):
    draw = random.Random(seed)
    sizes = [draw.choice((draw.randrange(1, 65), draw.randrange(1, 20), 64)) for _ in range(300)]
    number, offset = op.best_fit(np.array(sizes), 64)
    bins, room = plain_best_fit(sizes, 64)
    assert number.max() + 1 == bins and (64 - offset).tolist() == room


def check(spark, rows, window, group):
    out = op.pack(clashing(docs(spark, rows)), window=window, group=group).collect()
    known, texts = op.Ids(op.TOKENIZER), {}
    for doc_id, text in rows:
        ids = known.tokenizer.encode(text or "", add_special_tokens=False).ids + [op.END]
        texts.setdefault(doc_id, []).append(ids)
    got = {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and 0 < r["length"] <= window
        got.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    assert set(got) == set(texts)
    for doc_id, pieces in got.items():
        if len(texts[doc_id]) == 1:
            assert sum((p[1] for p in sorted(pieces)), []) == texts[doc_id][0]
        assert sum(len(p[1]) for p in pieces) == sum(map(len, texts[doc_id]))
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    lean = op.pack(docs(spark, rows), window=window, group=group, with_ids=False).drop("ids").collect()
    strip = lambda rs: sorted((tuple(r)[:7] for r in rs), key=str)
    assert strip(lean) == strip(out)
    return sum(window - sum(n for _, n in p) for p in sequences.values()) / (window * len(sequences))


def test_pieces_and_sequences(spark):
    rows = list(enumerate(ODD)) + [(100 + i, prose(i, 1 + i * 7 % 90)) for i in range(300)] + [(100, "again"), (None, "no id"), (None, None)]
    assert check(spark, rows, 512, 10**6) < 0.02
    check(spark, rows, 512, 60)


def test_equal_rows_are_dealt_to_all_groups(spark):
    out = op.pack(docs(spark, [(None, "same text")] * 4000), window=64, group=500).collect()
    groups = [r["sequence_id"] % 8 for r in out]
    assert len(out) == 4000 and max(map(groups.count, range(8))) < 700
    places = {(r["sequence_id"], r["offset"]) for r in out}
    assert len(places) == 4000


def test_empty_table(spark):
    assert op.pack(docs(spark, [])).collect() == []
