"""Kernels without Spark, against plain versions."""

import random
import struct
import unicodedata
import zlib

import numpy as np
import pytest

from netgap.llm import align, bpe, decontaminate, flat, mixer, near_dedup, substring_dedup, token_files, toxicity, weak_labels

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
PARTS = ["'s", "'re", "'", "s", " ", "  ", "\n", "\t", "\r\n", "1", "²", "é", "́", "中", "😀", "!", "%%", "\x1c", "\x85", "　", "ll", "abc", "don't", "\x00", "_", "<|endoftext|>"]


def texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "\n", "a" * 500, "%" * 100, "the " * 50]


def reference(some):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(some, add_special_tokens=False)], t


def test_bpe_equals_library_with_and_without_lexicon(tmp_path):
    some = texts()
    want, t = reference(some)
    v = bpe.vocabulary(PATH)
    words = sorted({b"the", b" the", b"abc", b"\n", b"don", b" donkey", b"abcd"})
    raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ids, n = v.merge(raw, np.cumsum(size) - size, size)
    (tmp_path / "x.bin").write_bytes(bpe.Lexicon.compile(words, ids, n).to_bytes())
    lexicon = bpe.Lexicon.open(str(tmp_path / "x.bin"))
    assert lexicon.find(raw, np.cumsum(size) - size, size).tolist() == list(range(len(words)))
    for lex in (None, lexicon):
        ids, at = bpe.encode(some, v, lex)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        assert bpe.decode(ids, at, v) == [t.decode(x, skip_special_tokens=False) for x in want]


def test_lexicon_shares_suffixes():
    words = sorted(a + b for a in (b"w", b"x", b"y", b"z") for b in (b"ing", b"ed"))
    lexicon = bpe.Lexicon.compile(words, np.arange(8), np.ones(8, np.int64))
    assert len(lexicon.final) == 6  # root, one state after any first letter, i-n-g and e-d share their end


def test_banded_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = a[:] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = [rng.choice("abd")]
        limit = rng.randint(0, 8)
        assert align.banded_distance(a, b, limit) == min(plain(a, b), limit + 1)


def test_token_frames_round_trip_and_checksums(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(token_files, "BLOCK", 4096)
    for n in (0, 1, 3, 511, 512, 1025, 4096, 4097, 20_000):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.int64)
        frame = token_files.pack([None, 7], np.array([n // 2, n - n // 2]), ids)
        keys, lengths, back = token_files.unpack(frame)
        assert keys == [None, 7] and lengths.tolist() == [n // 2, n - n // 2] and np.array_equal(back, ids)
    # each block has its own checksum: a change in one doesn't touch the others
    n_docs, n_ids, n_blocks, n_table = struct.unpack_from("<4Q", frame, 8)
    table = np.frombuffer(frame, "<u4", 5 * n_blocks, 40 + n_table).reshape(-1, 5)
    assert n_blocks == 5 and table[:, 0].tolist() == [4096] * 4 + [20_000 - 4 * 4096]
    at = 40 + n_table + table.nbytes
    for n, names, head, code, crc in table.tolist():
        broken = bytearray(frame)
        broken[at + head + code] ^= 0xFF
        with pytest.raises(ValueError):
            token_files.unpack(bytes(broken))
        block = mixer.decode_block(frame[at : at + head], np.frombuffer(frame, "<u2", code, at + head), n, names)
        assert zlib.crc32(block.astype("<u4").tobytes()) == crc
        at += head + 2 * code


def test_mixing_beats_single_orders_and_zlib():
    """Ids that depend on the two before them."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 3000, (40, 40, 3))
    x = [1, 2]
    for _ in range(120_000):
        x.append(int(table[x[-1] % 40, x[-2] % 40, rng.integers(3)]) if rng.random() < 0.8 else int(rng.zipf(1.2) % 3000))
    ids = np.array(x)
    head, code = mixer.encode_block(ids)
    assert np.array_equal(mixer.decode_block(head, code, len(ids), len(np.unique(ids))), ids)
    share = np.bincount(ids) / len(ids)
    order0 = -(share[share > 0] * np.log2(share[share > 0])).sum() * len(ids) / 8
    assert len(head) + 2 * len(code) < 0.9 * order0
    assert len(head) + 2 * len(code) < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    far = rng.integers(0, 1 << 32, 700)
    head, code = mixer.encode_block(far)
    assert np.array_equal(mixer.decode_block(head, code, 700, len(np.unique(far))), far)


def test_library_ids():
    some = texts(100)
    want, _ = reference(some)
    for part in (some, [t for t in some if "<|endoftext|>" not in t]):
        ids, at = token_files.library_ids(part, PATH)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w for t, w in zip(some, want) if t in part][: len(part)]


def test_library_ids_of_letters_that_python_does_not_know():
    """Letters and digits newer than Python's tables: the library knows them."""
    some = [f"a{c}a 1{c}1 {c}{c}'s\n{c} b" for c in ("\u1c89", "\ua7cb", "\U000105c0", "\U00010d40", "\U000116d0", "\u0378")]
    for part in ([t] for t in some):
        token_files._library.cache_clear()
        for _ in range(2):
            ids, at = token_files.library_ids(["a 1 b's", *part], PATH)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(["a 1 b's", *part])[0]
    assert min(b"\xcd", chr(0x378).encode()[:1]) == b"\xcd" and unicodedata.category(chr(0x378)) == "Cn"
    assert all(unicodedata.category(chr(c)) != "Cn" for c in range(0x340))


def test_pretokens_are_found_by_hash_and_bytes():
    known = token_files.Known()
    p, q = bpe.Pieces(["one two six"]), bpe.Pieces(["one ten three"])
    known.add(p, np.arange(len(p.at)), np.ones(3, np.int64), np.arange(3))
    words = p.words()
    assert known.find(p).tolist() == [0, 1, 2]
    assert [words[k] if k >= 0 else None for k in known.find(q)] == [w if w == b"one" else None for w in q.words()]
    known.keys[:] = q.keys  # other pretokens with the same hashes
    assert all(k < 0 or words[k] == w for k, w in zip(known.find(q).tolist(), q.words()))


def test_orders_are_mixed_once_for_each_context():
    """One table of mixtures, so that coding an id reads two values, not six, and decoding one for each step of its search."""
    rng = np.random.default_rng(9)
    names, x, counts = mixer.alphabet(rng.zipf(1.3, 40_000) % 700)
    model = mixer.Model(mixer.levels(counts), len(x))
    p1, p2 = mixer._before(x, 1), mixer._before(x, 2)
    for a, b in ((0, 500), (500, len(x))):
        model.learn(iter([(x[a:b], p1[a:b], p2[a:b])]))
    one, row = model.contexts(p1, p2)
    assert all(len(set(one[row == r].tolist())) == 1 for r in set(row.tolist())) and len(set(row.tolist())) > 1.5 * len(set(one.tolist()))
    begin = np.append(np.zeros((model.rows[1], 1), np.int64), model.mixed[1:].reshape(-1, mixer.BUCKETS)[:, :-1], 1)
    assert (np.diff(begin, axis=1) > 0).all()
    cum = [c.reshape(-1, mixer.WIDE)[:, :-1].astype(float) / (1 << mixer.LEVEL) for c in model.cum]
    w = model.weight[model.kind] / (1 << mixer.SHARE)
    want = w[:, :1] * model.cum0[:-1] / (1 << mixer.LEVEL) + w[:, 1:2] * cum[0][model.parent] + w[:, 2:] * cum[1]
    rest = (1 << mixer.SPAN) - mixer.BUCKETS
    assert np.abs(begin - want * rest - np.arange(mixer.BUCKETS)).max() < 4
    assert (w[np.unique(row), 1:] > 0.05).any(0).all()


def test_lanes_end_in_few_words():
    ids = np.random.default_rng(10).integers(0, 3, 100_000)
    head, code = mixer.encode_block(ids)
    assert np.array_equal(mixer.decode_block(head, code, len(ids), 3), ids)
    assert 16 * len(code) < 1.03 * len(ids) * np.log2(3) + 32 * mixer.shape(len(ids))[0]


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 40, 600).astype(np.uint64)
    first = np.array([0, 5, 300, 600])
    at = set(substring_dedup.winnow(flat.mix64(words), first, 13, 6).tolist())
    for a, b in zip(first, first[1:]):
        for s in range(a, b - 12):
            assert any(p in at for p in range(s, s + 8))
    keys, least, inside = substring_dedup.picks(flat.mix64(words), first, 13, 6)
    assert all({p for p in range(s, s + 8) if keys[p] == least[s]} <= at for s in np.flatnonzero(inside).tolist())


def test_order_minhash_follows_order():
    rng = np.random.default_rng(3)
    a = flat.mix64(np.arange(300, dtype=np.uint64))
    same = near_dedup.sketch(a.copy())
    assert (same == near_dedup.sketch(a)).all()
    b = a.copy()
    b[rng.integers(0, 300, 6)] = 5
    assert 12 < (near_dedup.sketch(b) == same).sum() < 80
    turned = np.concatenate((a[150:], a[:150]))
    assert (near_dedup.sketch(turned) == same).sum() < 62
    assert len(near_dedup.sketch(a[:1])) == sum(s.functions for s in near_dedup.SCALES)


def test_order_minhash_recall_at_similarity_of_0_8():
    """Texts with a fifth of their words replaced at random, the hardest pairs that still count as near copies."""
    rng = np.random.default_rng(1)
    for n in (5, 6, 8, 10, 20, 40, 60, 100, 150, 300, 1000):
        found = 0
        for _ in range(200):
            a = rng.integers(1, 1 << 60, n).astype(np.uint64)
            b = a.copy()
            b[rng.choice(n, n // 5, replace=False)] = rng.integers(1, 1 << 60, n // 5)
            found += bool(set(near_dedup.sketch(a).tolist()) & set(near_dedup.sketch(b).tolist()))
        assert found >= 180, (n, found)


def test_block_max_search_is_exact(monkeypatch):
    """Against cosines of full vectors, computed term by term."""
    monkeypatch.setattr(toxicity, "HEAD", 8)
    rng = np.random.default_rng(4)
    n, v = 1500, 120
    examples = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        t = sorted({int(x) for x in rng.zipf(1.3, 14) % (v - 2)} | ({v - 1 - i % 2} if y else set()))
        examples.append((i, y, t, rng.integers(1, 5, len(t)).tolist()))
    examples[7] = (7, 0, [], [])
    df = rng.integers(1, 90, v).astype(float)
    size = [len(e[2]) for e in examples]
    flat_terms, flat_counts = (np.array([x for e in examples for x in e[j]], np.int32) for j in (2, 3))
    held = toxicity.Examples(np.arange(n), np.array([e[1] for e in examples]), np.append(0, np.cumsum(size)), flat_terms, flat_counts)
    index = toxicity.build(held, [str(i) for i in range(v)], df, 100, 0.1)
    full = np.zeros((n, v))
    for i, _, t, c in examples:
        full[i, t] = np.log1p(c) * index.gain[t]
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-12)
    for k in range(120):
        _, _, t, c = examples[k]
        t = t if k % 2 else sorted(rng.choice(v, 6, replace=False).tolist())
        found = dict(zip(t, [1] * len(t)))
        q = np.zeros(v)
        q[t] = np.log1p(1) * index.gain[t]
        want = np.sort(full @ q / max(np.linalg.norm(q), 1e-12))[::-1][:10]
        p, s = index.search(*index.query(found), 10)
        assert np.allclose(want[want > 1e-9], s, atol=1e-5) and len(set(p.tolist())) == len(p)
        assert np.allclose(full[index.ids[p]] @ q / max(np.linalg.norm(q), 1e-12), s, atol=1e-5)
    assert toxicity.vote(index, {})[0] == 0.1


def test_decontamination_block():
    item = "the quick brown fox jumps over the lazy dog near the quiet river bank"
    block = decontaminate.Block([1, 2], [item, "short"], 8, 0.1)
    edited = item.replace("quick", "quack").replace("river", "rivers")
    some = ["nothing here at all", "before " + edited + " after", item[:40], "", "a short one"]
    assert sorted((k, i) for k, i, *_ in block.find(some)) == [(1, 0), (4, 1)]


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.9, 0.8, 0.85, 0.75, 0.9, 0.7]
    patterns = np.zeros(20_000, np.int64)
    for i, a in enumerate(accuracy):
        vote = np.where(rng.random(20_000) < a, truth, ~truth).astype(int)
        vote[rng.random(20_000) < 0.4] = weak_labels.ABSTAIN
        patterns += vote * 3**i
    p, n = np.unique(patterns, return_counts=True)
    model = weak_labels.expectation_maximisation(p, n.astype(float))
    assert abs(model.prior - 0.8) < 0.03 and np.abs(model.accuracy - accuracy).max() < 0.04
    assert ((model.posterior(patterns) > 0.5) == truth).mean() > 0.95


def test_hash_index():
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 60, 5000))
    index = flat.HashIndex(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys))) and (index.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert flat.HashIndex(np.zeros(0, np.int64)).find(np.array([3])).tolist() == [-1]


def test_word_hashes_do_not_depend_on_place():
    w = flat.Words(["a b", "", "b\n a  b"])
    h = w.hashes()
    assert w.counts().tolist() == [2, 0, 3] and h[0] == h[3] and h[1] == h[2] == h[4]


def test_mixer_brings_counted_contexts_up_to_date_and_no_others():
    rng = np.random.default_rng(8)
    names, x, counts = mixer.alphabet(rng.zipf(1.3, 60_000) % 500)
    model = mixer.Model(mixer.levels(counts), len(x))
    p1, p2 = mixer._before(x, 1), mixer._before(x, 2)
    for a, b in ((0, 50), (50, 400), (400, len(x))):
        model.learn(iter([(x[a:b], p1[a:b], p2[a:b])]))
        for count, cum, row, size in zip(model.count, model.cum, model.contexts(p1[:b], p2[:b]), model.rows, strict=True):
            want = np.zeros((size, mixer.BUCKETS), np.int64)
            np.add.at(want, (row, model.bucket[x[:b]]), 1)
            assert (count.reshape(want.shape) == want).all()
            n = want.sum(1)
            sums = np.cumsum(want, 1) * ((1 << 30) // np.maximum(n, 1))[:, None] >> (30 - mixer.LEVEL)
            sums[:, -1] = 1 << mixer.LEVEL
            full = np.where((n > 0)[:, None], np.append(np.zeros((size, 1), np.int64), sums, 1), model.cum0)
            assert (cum.reshape(full.shape) == full).all()
    seen = [set(r.tolist()) for r in model.contexts(p1, p2)]
    again = model.contexts(p1[:10], p2[:10])
    for cum, s, r in zip(model.cum, seen, again, strict=True):
        cum.reshape(-1, mixer.WIDE)[sorted(s - set(r.tolist())), 1] = 12345  # a mark, which only a needless update removes
    model.learn(iter([(x[:10], p1[:10], p2[:10])]))
    for cum, s, r in zip(model.cum, seen, again, strict=True):
        rest = sorted(s - set(r.tolist()))
        assert len(rest) > 50 and (cum.reshape(-1, mixer.WIDE)[rest, 1] == 12345).all()
