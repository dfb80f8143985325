import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.llm import mph, packing, token_files, tokens
from reprise.storage import scratch_path
from tests.llm import data


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_words_give_the_ids_of_whole_texts(slow):
    odd = ["a b <|endoftext|> x<|endoftext|>y Qİz ΑΣ Σ é ́ don't I'll 123abc x\u0085y a‍b", "H̱ J̌ kK ﬁ ½ ²", "≠ ≮ a≠!", "É!!! né... 'S 'll's", "x" * 3000, "ẖ̱ ab́,", "ǅ ŉ ß ẞ ı ſ", "日本語 テスト。"]
    texts = odd + [t for _, t in data.texts()]
    encode = tokens.encoder()
    for _ in range(2):
        for t, got in zip(texts, encode(texts), strict=True):
            assert np.array_equal(np.frombuffer(got, "<u4"), slow(t)), t


def test_new_words_take_few_calls_and_known_ones_none():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{c}{end}" for a in letters for b in letters for c in "xyz" for end in ("", ",")]
    encode, calls = tokens.encoder(), []

    def counted(texts):
        calls.clear()
        sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
        try:
            return encode(texts)
        finally:
            sys.setprofile(None)

    tokens._TABLES[tokens.default_vocabulary()].clear()
    first = counted([" ".join(words)])
    assert len(calls) <= 14 * len(words)
    assert counted([" ".join(words)]) == first
    assert len(calls) < 50


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64)
    table = mph.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    again = mph.load(mph.dump({"sizes": table.sizes, "bits": np.packbits(table.bits)}))
    assert np.array_equal(again["sizes"], table.sizes)
    none = mph.PerfectHash.build(np.zeros(0, np.uint64))
    assert none.slots(keys[:3]).tolist() == [-1, -1, -1]


def test_files(spark, slow):
    docs = data.documents(spark)
    rows = sorted(data.texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for i, t in rows:
        ids = np.append(slow(t), np.uint32(1)).astype("<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.encode_to_files(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_keyed_access(spark, slow):
    rows = [(k * 3, f"text number {k} word") for k in range(300)]
    manifest = token_files.write_ids(data.documents(spark, rows), scratch_path(spark, "t")).collect()
    hits = 0
    for m in manifest:
        shard = token_files.Shard(m["payload"], m["index"], m["width"])
        offsets, lengths = shard.find([k * 3 for k in range(300)], [0] * 300)
        for k in np.nonzero(offsets >= 0)[0].tolist():
            hits += 1
            assert np.array_equal(np.frombuffer(shard.read(offsets[k], lengths[k]), "<u4")[:-1], slow(rows[k][1]))
        missing, _ = shard.find([k * 3 + 1 for k in range(300)], [0] * 300)
        assert (missing < 0).all()
        shard.close()
    assert hits == 300 and sum(m["n_docs"] for m in manifest) == 300


def test_no_files(spark):
    assert token_files.encode_to_files(data.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fullest_is_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    counts = {int(s): int(rng.integers(1, 4)) for s in rng.choice(40, 6, replace=False) + 1}
    room = int(rng.integers(20, 90))
    sums = {0}
    for s, n in counts.items():
        sums = {a + s * k for a in sums for k in range(n + 1)}
    used = packing.fullest(counts, room)
    assert sum(s * n for s, n in used.items()) == max(x for x in sums if x <= room) and all(n <= counts[s] for s, n in used.items())


def test_plan_holds_every_piece():
    histogram = {2048: 7, 2000: 5, 48: 9, 1024: 3, 1: 100, 700: 11}
    got = defaultdict(int)
    for times, used in packing.plan(histogram):
        assert sum(s * n for s, n in used.items()) <= 2048
        for s, n in used.items():
            got[s] += n * times
    assert dict(got) == histogram


def first_fit(lengths, room):
    """Bins by first fit, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, used in enumerate(bins) if used + n <= room), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return bins


@pytest.mark.parametrize("run", [50_000, 7])
def test_packing(spark, slow, run):
    docs = data.documents(spark)
    rows = packing.pack(docs, 256, with_ids=True, run=run).collect()
    expected = []
    for i, t in data.texts():
        ids = np.append(slow(t), np.uint32(0)).astype("<u4")
        expected += [(i, n, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for n, at in enumerate(range(0, len(ids), 256))]
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(str, (tuple(r[k] for k in key) for r in rows))) == sorted(map(str, expected))
    bins = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= len(first_fit([r["length"] for r in rows], 256))


def test_pack_nothing(spark):
    assert packing.pack(data.empty(spark)).count() == 0


def test_query_sum(spark):
    docs = data.documents(spark)
    assert token_files.encode_to_files(docs).agg(F.count("*")).first()[0] == docs.count()


def test_random_words_as_the_library_has_them():
    """Every mix of dotted capitals, combining marks, marks and letters gives the library's ids."""
    import random

    from tokenizers import Tokenizer

    from reprise.llm import tokens

    rng = random.Random(3)
    own, whole = tokens.encoder(), Tokenizer.from_file(tokens.default_vocabulary())
    letters = "aZ09\u0130\u0131\u00df\u00e9\u00c9\u0307\u0301\u01c5\ufb01\u1e9e\u4e2d\U0001f600\u03a3\u2126\u00bd'.,!-|<>#*"
    texts = ["TAR\u0130H\u0130.", "\u0130!", "a\u0130|b"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(60_000)]
    expected = whole.encode_batch_fast(texts, add_special_tokens=False)
    for text, got, e in zip(texts, own(texts), expected, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.ids, ascii(text)
