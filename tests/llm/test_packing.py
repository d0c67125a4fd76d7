import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm.packing import Encoder, Slack, pack
from lodestone.llm.queries import byte_bpe


def check(frame, capacity=2048):
    tok = Tokenizer.from_file(byte_bpe())
    ids = defaultdict(list)
    for r in frame.collect():
        ids[r.doc_id].append(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in pack(frame, byte_bpe(), capacity=capacity).collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        assert {p.doc_tokens for p in ps} == {len(x) for x in ids[d]}
        assert sum(p.length for p in ps) == sum(len(x) for x in ids[d])
        if len(ids[d]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                assert zlib.crc32(ids[d][0][at : at + p.length].tobytes()) == p.ids_crc32
                at += p.length
    padding = total = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    assert padding <= 0.001 * total
    return len(sequences)


def test_whole_table(docs):
    check(docs)
    check(docs.repartition(5))


def test_odd_rows(odd, empty):
    check(odd)
    check(odd, 64)
    assert pack(empty, byte_bpe()).collect() == []


def test_encoder_equals_the_library(docs, odd):
    tok, mine = Tokenizer.from_file(byte_bpe()), Encoder(byte_bpe())
    texts = [r.text or "" for r in docs.collect()] + [r.text or "" for r in odd.collect()]
    texts += ["<|endoftext|>", "it's  I'LL\r\n\n  x y 1234567 กำ 🙂🙂", "\x00\x01", " lead", "trail "]
    for t in texts:
        assert mine.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_slack_is_minimal():
    """The fullest window with the longest length, against all subsets."""
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        slack = Slack(capacity)
        for x in lengths:
            slack.count[x] += 1
        top = max(lengths)
        rest = list(lengths)
        rest.remove(top)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        taken = slack.fill()
        assert sum(k * n for k, n in taken.items()) == top + max(s for s in sums if top + s <= capacity)
        assert all(n <= lengths.count(k) for k, n in taken.items()) and taken[top] >= 1
        assert sum(k * n for k, n in slack.count.items()) == sum(lengths) - sum(k * n for k, n in taken.items())
