import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelcast.llm import packing
from panelcast.llm.tokens import Encoder

from .conftest import LONG


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check(pieces, rows, tokenizer, size):
    """Each id in exactly one piece, right checksums, gapless sequences without padding."""
    want = sorted((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
    for i, ids in want:
        own = [p for p in pieces if str(p.doc_id) == i and p.doc_tokens == len(ids)]
        data = np.array(ids, "<u4")
        ok = [p for p in own if zlib.crc32(data[p.start:p.start + p.length].tobytes()) == p.ids_crc32]
        covered = set()
        for p in ok:
            covered |= set(range(p.start, p.start + p.length))
        assert covered == set(range(len(ids)))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size and (at == size or at & (at - 1) == 0)
    return sequences


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(f"word{rng.randrange(999)}" for _ in range(rng.randint(1, 300)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, LONG[:60000]), (203, "It's <|endoftext|> 漢字 É"), (5, "again"), (None, "x y z")]
    sources = [rng.choice(["a", "a", "a", "b", "c"]) for _ in rows]
    sources[3] = None
    return rows, sources


def test_every_id_is_packed_once(make_docs, tokenizer):
    rows, sources = corpus()
    docs = make_docs(rows, sources=sources)
    for options in ({}, {"pack_tokens": 20000}, {"pack_tokens": 20000, "weights": {"b": 3.0, "a": 1.0}, "size": 512, "grain": 64}):
        got = packing.pack(docs, **options).collect()
        check(got, rows, tokenizer, options.get("size", 2048))


def test_windows_follow_the_target_and_carry_deficits():
    rng = np.random.default_rng(0)
    length = rng.integers(1, 900, 600)
    queue = rng.choice(3, 600, p=[0.5, 0.3, 0.2])
    total = np.bincount(queue, length)
    share = total / total.sum()
    used, windows = np.zeros(3), 0
    mix = {}
    for d, _, n, w, _ in packing.fill(queue, length, share, np.zeros(3), 2048, 256):
        mix.setdefault(w, np.zeros(3))[queue[d]] += n
    for w in range(max(mix)):
        used += mix[w]
        windows += 1
        assert np.abs(used - share * 2048 * windows).max() < 2 * 2048  # what is owed never piles up
    assert np.abs(np.array([mix[w] for w in range(max(mix))]) / 2048 - share).mean() < 0.1


def test_packs_carry_deficits_on():
    # a source that is owed much at the start of a pack comes first
    queue, length = np.array([0, 1] * 20), np.full(40, 500)
    first = next(packing.fill(queue, length, np.array([0.5, 0.5]), np.array([-5000.0, 5000.0]), 2048, 256))
    assert queue[first[0]] == 1


def test_short_tail_needs_no_padding():
    pieces = [(0, 0, 700, 9, 0), (1, 0, 300, 9, 700)]
    cut = list(packing.halve(pieces, 1000, 2048))
    size = {}
    for _, _, n, w, o in cut:
        assert o == size.get(w, 0)
        size[w] = o + n
    assert list(size.values()) == [512, 256, 128, 64, 32, 8]


def test_remembered_words_give_the_tokenizers_ids(tokenizer):
    enc = Encoder(packing.TOKENIZER)
    for t in ["It's <|endoftext|> here", "a b c\x1cd \x85e", "ÀÉÎ×÷ªº ² ½x ΑΣ ΣΑΣ İ ß ẞ 漢字 テ", "don't!'s '' 'LL we'll''",
              "naïve ́x", "🎉a😀b", "\t\r\n x\x0by\x0cz", "x" * 200, ""]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_empty_table(make_docs):
    assert packing.pack(make_docs(["a"]).limit(0)).count() == 0
