"""Registered queries end to end against brute force, input columns of any name, and the order of the mix."""

import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import media, mixing, quality, queries, simhash
from wayfare.llm.common import free_name, shared_dir
from wayfare.llm.components import components

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLOCK = mixing.BLOCK_ROWS


def _docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _check_shares(rows, counts, weights=None):
    """rows of (source, position) in any order: dense, each source less than a block from its share in rows after each slot."""
    rows = sorted(rows, key=lambda r: r[1])
    share, period = mixing.parts(weights or mixing.flattened(counts))
    seen, slots = collections.Counter(), sorted({p // BLOCK for _, p in rows})
    assert slots == list(range(len(slots)))
    by_slot = collections.defaultdict(list)
    for s, p in rows:
        by_slot[p // BLOCK].append(s)
    for t, slot in enumerate(slots, 1):
        assert len(set(by_slot[slot])) == 1
        for s in by_slot[slot]:
            seen[s] += 1
        if t < len(slots):  # the very last block may be short
            assert all(abs(seen[k] - t * BLOCK * share[k] / period) < BLOCK + 1e-9 for k in share)


def test_op4_pfair_mix(spark):
    """The whole query: rows meet the weights within a block, epochs of a source are complete, nothing is lost."""
    got = queries.op4_pfair_mix(spark, SF_MORE).collect()
    docs = _docs(spark, SF_MORE).select("doc_id", "source").collect()
    counts = collections.Counter(r.source for r in docs)
    assert len({r.position for r in got}) == len(got)
    _check_shares([(r.source, r.position) for r in got], counts)
    first = collections.Counter((r.doc_id, r.source) for r in got if r.epoch == 0)
    assert first == collections.Counter((r.doc_id, r.source) for r in docs)
    by = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in got:
        by[r.source][r.epoch].add(r.doc_id)
    for s, epochs in by.items():
        last = max(epochs)
        assert all(len(epochs[e]) == counts[s] for e in epochs if e < last)
    again = queries.op4_pfair_mix(spark, SF_MORE)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_mix_small_sources(spark):
    """Rows, not blocks, meet the weights, with a source of one document and one of 33."""
    n = {"hot": 3000, "one": 1, "few": 33}
    d = spark.createDataFrame([(i, f"text {s} {i}", s) for s, k in n.items() for i in range(k)], "doc_id long, text string, source string")
    weights = {"hot": 0.5, "one": 0.25, "few": 0.25}
    got = mixing.mix(d, weights).collect()
    _check_shares([(r.source, r._mix.position) for r in got], n, weights)
    of = collections.Counter(r.source for r in got)
    assert abs(of["one"] - of["few"]) <= BLOCK and abs(of["hot"] - 2 * of["one"]) <= 2 * BLOCK


def test_mix_many_sources(spark):
    """More sources than the least period has parts."""
    d = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    got = mixing.mix(d, period=8, block_rows=1).collect()
    assert {r.doc_id for r in got} == set(range(60)) and len({r._mix.position for r in got}) == len(got)


NAMES = "_h _i _s _n _k _slot _b _q _mix _id _key _before _epoch c0 c1 k h g i j x s s1 t id fp key epoch row `a.b`".split()


def _clashing(spark):
    words = "the cat of the house and a dog in that town was on its way to be with us "
    rows = [(i, f"{words} number {i} of {i * 7919}. " + " ".join(f"w{i * 31 + k}" for k in range(60)), f"s{i % 3}", *[i * 100 + k for k in range(len(NAMES))]) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def _same(out, d):
    assert out.columns[: len(d.columns)] == d.columns
    pick = lambda x: sorted(tuple(r)[: len(d.columns)] for r in x.collect())
    return pick(out), pick(d)


def test_clashing_columns_keep_their_values(spark):
    import corpus_pipeline as p

    d = _clashing(spark)
    m = mixing.mix(d)
    got, want = _same(m.where(F.col(f"`{m.columns[-1]}`")["epoch"] == 0), d)
    assert got == want and m.columns[-1] == "__mix" and len(m.columns) == len(d.columns) + 1
    q = quality.annotate(d)
    got, want = _same(q, d)
    assert got == want and q.columns[-1] == "__q"
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        rows, want = sorted(map(tuple, out.collect())), sorted(map(tuple, d.collect()))
        assert set(rows) <= set(want) and (set(rows) == set(want) or name == "SimHash near-dedup"), name
    assert free_name(d, "_Q") == "__Q" and free_name(d, "new") == "new"


def test_repeated_rows_in_the_mix(spark):
    """A third of all rows alike in every column: each is a row of its own."""
    d = spark.createDataFrame([(1, "same", "a")] * 500 + [(i, f"t{i}", "a" if i % 2 else None) for i in range(2, 1000)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert sum(r.doc_id == 1 and r._mix.epoch == 0 for r in got) == 500 and len({r._mix.position for r in got}) == len(got)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def _fingerprint(t):
    w = _words(t)
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_op7_simhash(spark):
    docs = {r.doc_id: _fingerprint(r.text) for r in _docs(spark, SF_MORE).collect()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (docs[a] ^ docs[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF_MORE).collect()}
    assert got == {i: (f"{docs[i]:016x}", root(i)) for i in ids}


def test_op6_suffix_dedup(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in _docs(spark, SF_MORE).collect()}
    of = xxhash.xxh3_128_digest
    count = collections.Counter(of(t[i : i + 400]) for t in texts.values() for i in range(len(t) - 399))
    want = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[of(t[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[k] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF_MORE).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 50


def test_op6_shared_passages(spark):
    """A passage of over 50 words, too short to be removed, is told in each of the documents that have it."""
    split = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in _docs(spark, SF_MORE).collect()}
    where = collections.defaultdict(set)
    for k, w in split.items():
        for i in range(len(w) - 49):
            where[hash(tuple(w[i : i + 50]))].add(k)
    want = {k: len({i + j for i in range(len(w) - 49) if len(where[hash(tuple(w[i : i + 50]))]) > 1 for j in range(50)}) for k, w in split.items()}
    got = {r.doc_id: (r.n_shared_words, r.n_removed) for r in queries.op6_suffix_dedup(spark, SF_MORE).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert any(n and not gone for n, gone in got.values()) and any(gone and not n for n, gone in got.values())


def test_op3_blocks_and_features(spark, tmp_path):
    """Blocks of the written table are sought by offset; features and the stream's digest are of the payload."""
    docs = _docs(spark)
    blocks = media.pcm_blocks(media.stored(docs), together=1)
    blocks.write.parquet(str(tmp_path / "pcm"))
    blocks = spark.read.parquet(str(tmp_path / "pcm"))
    data = {r.doc_id: media.payload((r.text or "").encode()) for r in docs.collect()}
    for first, n in ((0, 10), (1000, 100), (2047, 3), (10**9, 5)):
        got = {r.id: bytes(r.pcm) for r in media.samples(blocks, first, n).collect()}
        assert got == {i: p[first : first + n] for i, p in data.items()}
    for r in media.read_back(blocks).collect():
        p = data[r.id]
        x = [b - 128 for b in p]
        mean = sum(x) / len(x)
        sign = [v >= mean for v in x]
        want = {"mean": mean, "std": (sum(v * v for v in x) / len(x) - mean**2) ** 0.5, "crossings": sum(a != b for a, b in zip(sign, sign[1:])), "peak": max(map(abs, x))}
        said = dict(f.split("=") for f in r.feature.split(";"))
        assert all(float(said[k]) == pytest.approx(v, abs=2e-4) for k, v in want.items())
        assert (r.media_sha256, r.media_bytes) == (lambda s: (hashlib.sha256(s).hexdigest(), len(s)))(media.encode([p])[0])
    with pytest.raises(ValueError, match="pcm"):
        media.joined([{"sample_offset": 0, "pcm": b"ab"}, {"sample_offset": 3, "pcm": b"c"}])


def test_contract_columns(spark):
    want = {
        "op3_media_flac": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op10_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, SF).columns[: len(cols.split())] == cols.split()


def test_order_of_the_mix_in_the_result(spark, tmp_path):
    """Written and reread, the mix's table holds its order, and the last stage gives it with each row."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = _docs(spark, SF_MORE)
    stages["mixing sources to target weights"](spark, docs, SF_MORE).write.parquet(str(tmp_path / "mix"))
    out = stages["byte-level BPE encoding and decoding"](spark, spark.read.parquet(str(tmp_path / "mix")), SF_MORE)
    assert out.columns[:4] == ["doc_id", "mix_part", "mix_row", "n_tokens"]
    rows = sorted(out.select("mix_part", "mix_row", "doc_id").collect())
    want = queries.op4_pfair_mix(spark, SF_MORE).orderBy("position").select("doc_id").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in want] and len({r[:2] for r in rows}) == len(rows)


def test_components_that_do_not_settle(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(e, max_rounds=1)


def test_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def __init__(self, sc):
            self._sc = sc

        def __getattr__(self, name):
            return getattr(self._sc, name)

        class _Unset:
            def get(self, key):
                return None

        def getConf(self):
            return self._Unset()

        class _Jsc:
            def sc(self):
                return self

            def getCheckpointDir(self):
                return self

            def isDefined(self):
                return False

        _jsc = _Jsc()

    class Session:
        sparkContext = Context(spark.sparkContext)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session())


def test_links_hold_simhash_budget(spark):
    """A chain of fingerprints three bits apart is one component, though its ends are far apart."""
    fps = [(1 << 3 * k) - 1 for k in range(1, 10)]
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {r.root for r in components(simhash.links(d, len(fps))).collect()} == {fps[0]}
