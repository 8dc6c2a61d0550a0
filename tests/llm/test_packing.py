import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameloom.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        end = 0
        for offset, length in places:
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def optimum(lengths, capacity):
    """Fewest bins by search, for few items."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_bound_never_exceeds_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 97, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    best = optimum(lengths, capacity)
    assert packing.lower_bound(np.array(lengths), capacity) <= best
    assert packing.best_fit_decreasing(np.array(sorted(lengths, reverse=True)), capacity)[2] >= best


def test_ids_equal_the_library():
    from frameloom.llm.subwords import word_bpe

    rng = random.Random(8)
    parts = ["a", "B", "word", "É", "é", "ß", "İ", "µ", "²", "½", "×", "_", ".", ",", "..", "'", "'s", "'T", "it's", "-", '"', "(", "1", "23", " ", " ", " ", "\n", "\t", "\x85", "\xa0", "\x1c", "\x00", "日", "Σ", "é", "ﬁ", "<|", "<|endoftext|>", "\U0001f642"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["".join(rng.choice(parts[:33]) for _ in range(30)) for _ in range(2000)]
    library, of = Tokenizer.from_file(WORD), word_bpe(WORD)
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 500) for x in of.ids(texts[i : i + 500])]
    assert [(t, x) for t, x in zip(texts, got, strict=True) if x != library.encode(t, add_special_tokens=False).ids] == []


def test_pieces_round_trip(odd, none):
    pieces = packing.pieces_of(odd, WORD, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    want = sorted(library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd.collect())
    by, loose = {}, []
    for p in sorted(pieces, key=lambda p: (p.doc_id or 0, p.start)):
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.start == 2048 * p.piece
        if p.doc_id == 4:
            loose.append(np.frombuffer(p.ids, "<u4").tolist())
        else:
            by.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted([*by.values(), *loose]) == want
    packed = packing.pack(packing.pieces_of(odd, WORD)).collect()
    assert len(packed) == len(pieces)
    check_places(packed, 2048)
    assert packing.pack(packing.pieces_of(none, WORD)).count() == 0


def test_repacking_nears_the_bound(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i, None) for i, n in enumerate(lengths)], packing.PIECES)
    def pack(*how):
        rows = packing.pack(pieces, 100, *how).collect()
        assert all(r.bins >= r.bound >= 1 for r in rows)
        return check_places(rows, 100)

    once, exchanged, together = pack(100, 1), pack(100), pack(3000)
    assert packing.lower_bound(np.array(lengths), 100) <= together <= exchanged < once
    assert together <= packing.lower_bound(np.array(lengths), 100) * 1.01


def test_the_exchange_goes_on_until_nothing_is_saved(spark):
    """Many small partitions: what is certified has as many bins as its bound, and no bin is lost on the way."""
    rng = random.Random(6)
    lengths = [rng.choice([34, 35, 51, 60, 97]) for _ in range(400)] + [rng.randint(1, 30) for _ in range(60)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i, None) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces, 100, 20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(460))
    first = check_places(packing.pack(pieces, 100, 20, 1).collect(), 100)
    assert packing.lower_bound(np.array(lengths), 100) <= check_places(rows, 100) <= first


@pytest.mark.parametrize("seed", range(4))
def test_a_certified_packing_is_the_optimum(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(5, 60) for _ in range(9)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i, None) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces, 100).collect()
    used, best = check_places(rows, 100), optimum(lengths, 100)
    assert used >= best and (any(r.bins > r.bound for r in rows) or used == best)
