import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notegraph.llm import tokenbits as T
from notegraph.llm.scratch import shared_dir

SPEC = T.Spec(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows):
    """Ids of (doc_id, text) rows by the library alone, in id order."""
    tk = Tokenizer.from_file(SPEC.tokenizer)
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, T.digest(docs, SPEC).collect())) == brute((r.doc_id, r.text) for r in docs.collect())


ODD = [
    (5, "It's we'll ÄÖÜ straße école Éa ÀÀ 123 4.5 <|endoftext|> a<|startoftext|>b don't'VE"),
    (3, None),
    (9, ""),
    (-4, " \n\t\x0b\x0c\r "),
    (8, "漢字かな交じり文。日本語テスト é  x y\u0085z \x1c Ǆ İ ﬁ ½ “a” ΑΣ."),
    (11, "word " * 30000),
    (12, "x" * 5000 + "\x00y~`'s'"),
    (None, "no id"),
]


def test_odd_texts(docs_of):
    docs = docs_of(ODD)
    assert sorted(map(tuple, T.digest(docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "at"), SPEC).collect()), key=lambda r: r[1]) == brute(ODD)


def test_empty_table_and_repeated_ids(docs_of):
    assert T.digest(docs_of([]), SPEC).collect() == []
    rows = [(7, "a b"), (7, "a b"), (7, "c"), (6, "d e f")]
    out = sorted(map(tuple, T.digest(docs_of(rows), SPEC).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [6, 7, 7, 7] and [r[1] for r in out] == [0, *np.cumsum([r[2] for r in out])[:-1]]
    assert sorted(r[2:] for r in out) == sorted(r[2:] for r in brute(rows))


def test_many_shards_and_slices(spark, docs_of):
    """Shards of few ids, cut by partition and size; any stretch decodes alone."""
    rows = [(i, f"paper number {i} on " + "the harvest of grain " * (i % 40)) for i in range(300)]
    path = f"{shared_dir(spark)}/{tempfile.mkdtemp().rsplit('/', 1)[1]}"
    spec = T.Spec(SPEC.tokenizer, block=16, chunk_blocks=8, shard_tokens=2000)
    T.write(docs_of(rows).repartition(5), path, spec)
    shards = spark.read.parquet(f"{path}/manifest").orderBy("at").collect()
    assert len(shards) > 5 and sum(r.n_docs for r in shards) == 300
    for step in (1, 500, 1 << 20):
        out = sorted(T.read(spark, path, step).collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in out] == brute(rows)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in out])
    at = 0
    for r in shards:
        shard = T.Shard(f"{path}/shards/{r.file}")
        for a, b in ((0, 1), (15, 17), (16, 32), (100, 333), (r.n_tokens - 1, r.n_tokens), (5, 5)):
            b = min(b, r.n_tokens)
            assert (shard.ids(a, b) == every[at + a : at + max(a, b)]).all()
        at += r.n_tokens


def huffman_cost(counts):
    """Total bits of an unlimited Huffman code."""
    import heapq

    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def limited_cost(counts, bits):
    """Least total bits of a prefix code with lengths up to ``bits``, by search."""
    n, c = len(counts), sorted(counts, reverse=True)
    best = {(0, 0): 0}
    for x in c:  # lengths don't fall along falling counts
        nxt = {}
        for (last, room), cost in best.items():
            for length in range(max(last, 1), bits + 1):
                used = room + (1 << (bits - length))
                if used <= 1 << bits:
                    key = (length, used)
                    nxt[key] = min(nxt.get(key, 10**18), cost + x * length)
        best = nxt
    return min(best.values()) if n else 0


@pytest.mark.parametrize("bits", [3, 4, 5, 7])
def test_code_lengths_are_the_best_within_the_limit(bits):
    rng = np.random.default_rng(bits)
    for _ in range(15):
        counts = rng.integers(1, 400, rng.integers(2, 9)) ** 2
        lengths = T.code_lengths(np.insert(counts, 1, 0), bits)
        assert lengths[1] == 0 and lengths.max() <= bits
        lengths = np.delete(lengths, 1).astype(int)
        assert (2.0**-lengths).sum() == 1
        assert (lengths * counts).sum() == limited_cost(counts.tolist(), bits)
        if bits == 7:
            assert (lengths * counts).sum() == huffman_cost(counts.tolist())


def test_limits_of_codes():
    assert T.code_lengths(np.array([0, 0, 9]), 8).tolist() == [0, 0, 1]
    assert T.code_lengths(np.zeros(0, int), 8).tolist() == []
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(9, int), 3)
    one = T.Codes(T.code_lengths(np.array([0, 5]), 8), 8)
    data, offsets = T.pack(np.ones(1000, np.uint32), one, 64)
    assert len(data) == 125 and (T.unpack(data, offsets, 1000, one, 64) == 1).all()


def test_forgetting_changes_nothing():
    few, many = (T.Words(SPEC.tokenizer, n) for n in (1, 1 << 28))
    for i in range(5):
        raw = np.frombuffer(f"alpha beta{i} gamma-delta {i * 7} été".encode(), np.uint8)
        a, b = (w.encode(raw, np.array([0, 10, len(raw)])) for w in (few, many))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
