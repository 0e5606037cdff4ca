from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm.packing import best_fit, pack
from shelfmark.llm.tokens import PIECE, ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " leading and trailing  ", "<|endoftext|> inside", "a<|endoftext|><|endoftext|>b <|endoftext|", "word <|endoftext|> " * 9000, "naïve café 東京 🙂‍🔥\n\n\t x", "don't we'll I'VE", "1234567 8.9", "   odd　spaces \r\n", "x" * 3000, "\0\x1f\x7f"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, prose):
    for text in [*TEXTS, prose(400, 1), prose(PIECE // 3, 2), "word " * PIECE, "  \n " * PIECE]:
        assert ids(text, PATH).tolist() == library(text)


def held(rows, out, library, capacity):
    """The pieces are the documents' ids, whole, in order, gapless in their sequences."""
    want, lanes, pieces = {d: [*library(t), 2] for d, t in rows}, {}, {}
    for r in out:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        lanes.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for own in lanes.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for d, own in pieces.items():
        own.sort()
        n, k = len(want[d]), -(-len(want[d]) // capacity)
        assert [p for p, _, _ in own] == list(range(k))
        assert [s for _, s, _ in own] == [0, *(n - capacity * (k - j) for j in range(1, k))]
        assert sum(x for *_, x in own) == n
    assert set(pieces) == set(want)
    return len(lanes), sum(map(len, want.values()))


def test_pack(frame, prose, library):
    rows = [*enumerate(TEXTS), *((100 + k, prose(20 + 37 * k, k)) for k in range(60))]
    lanes, total = held(rows, pack(frame(rows), PATH).collect(), library, 1024)
    assert lanes <= 1.1 * -(-total // 1024) + 1


def test_empty_table(frame):
    assert pack(frame([]), PATH).collect() == []


def test_rows_without_id_are_left_out(frame):
    assert {r.doc_id for r in pack(frame([(None, "a"), (1, "b")]), PATH).collect()} == {1}


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_every_limit_holds(select):
    lengths = np.random.default_rng(0).integers(1, 200, 2000)
    limits = (200, 5, 15_000 + 200**2)
    bins, offsets = best_fit(lengths, limits, (1.0, 0.3, 0.3), select)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= limits[0] and len(own) <= limits[1] and (own.astype(int) ** 2).sum() <= limits[2]
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == np.concatenate([[0], np.cumsum(own[order])[:-1]]).tolist()
    with pytest.raises(ValueError, match="exceeds"):
        best_fit(np.array([201]), limits, (1, 1, 1), select)


def test_max_docs(frame, prose, library):
    rows = [(k, prose(3, k)) for k in range(40)]
    out = pack(frame(rows), PATH, max_docs=4).collect()
    held(rows, out, library, 1024)
    assert max(np.unique([r.sequence_id for r in out], return_counts=True)[1]) == 4


def test_max_attention(frame, prose, library):
    rows = [(k, prose(20 + k % 40, k)) for k in range(60)]
    want = {d: len(library(t)) + 1 for d, t in rows}
    most = 2 * max(want.values()) ** 2
    out = pack(frame(rows), PATH, max_attention=most, capacity=512).collect()
    held(rows, out, library, 512)
    lanes = {}
    for r in out:
        lanes.setdefault(r.sequence_id, []).append(r.length)
    costs = [sum(x * x for x in own) for own in lanes.values()]
    assert max(costs) <= most and sorted(costs)[len(costs) // 2] > most // 2
    assert any(sum(own) + min(want.values()) <= 512 for own in lanes.values())  # tokens were left: attention bound
