"""Every operator on nulls, empty and long texts, repeated rows and ids, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from wayfare.llm import bpe, html, licenses, media, mixing, quality, secrets, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, t string, h long, n int, fp long, host string, _h long"
LONG = "some words of a long text " * 8000
TEXTS = [None, "", " \n\t", "word", "two words", LONG, "naïve café – 日本語 😀 x", "dup text here", "dup text here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x" * 5000]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "clash", 1, 2, 3, "clash", 5) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    return _docs(spark, [*rows, rows[3], (3, "other text, same id", "s1"), (None, "no id", None)])


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def operators():
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return {
        "bpe": lambda d: bpe.encode_decode(d, path, P.PATTERN),
        "media": lambda d: media.read_back(media.pcm_blocks(media.stored(d))),
        "mixing": lambda d: mixing.mix(d),
        "toxicity": lambda d: toxicity.apply(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))),
        "suffix": lambda d: suffix.without_repeats(d),
        "simhash": lambda d: simhash.groups(d),
        "quality": lambda d: quality.annotate(d),
        "licenses": lambda d: licenses.scan(d),
        "secrets": lambda d: secrets.scan(d, secrets.train(d)),
        "redact": lambda d: secrets.redact(d, secrets.train(d)),
        "html": lambda d: html.main_text(d, "doc_id", "source", "text"),
    }


@pytest.mark.parametrize("name", ["bpe", "media", "toxicity", "suffix", "simhash", "quality", "licenses", "secrets", "redact", "html"])
def test_one_row_each(docs, empty, name):
    f = operators()[name]
    assert len(f(docs).collect()) == docs.count()
    assert f(empty).collect() == []


def test_mix_keeps_all(docs, empty):
    got = mixing.mix(docs).collect()
    assert sum(r._mix.epoch == 0 for r in got) == docs.count() and len({r._mix.position for r in got}) == len(got)
    assert mixing.mix(empty).collect() == []


def test_null_is_empty(docs):
    r = {x.id: x for x in media.read_back(media.pcm_blocks(media.stored(docs.where("doc_id < 2")))).collect()}
    assert r[0].n_bytes == 0 and r[0].payload_bytes == 64 and r[0].media_sha256 == r[1].media_sha256
    q = {x.doc_id: x._q for x in quality.annotate(docs.where("doc_id < 3")).collect()}
    assert all(q[i].n_words == 0 and q[i].base_failed and not q[i].kept for i in range(3))
    f = {x.id: x for x in simhash.groups(docs.where("doc_id < 3")).collect()}
    assert all(f[i].fp == 0 and f[i].component == 0 for i in range(3))
