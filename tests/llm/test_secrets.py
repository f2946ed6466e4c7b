"""The field of the secret scan on forms of secrets that no base pattern finds, on what only looks like them, and its exactness."""

import random
import re

import numpy as np
import pytest

from wayfare.llm import secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    return secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))


def made(n=200, seed=5):
    """(text, start, end) of secrets in sentences, each form about as often: letters only, short ones, with symbols, in addresses."""
    r = random.Random(seed)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    forms = [
        lambda: ("the database pwd = ", pick(low, 12), ""),  # letters only
        lambda: ("use passphrase: ", pick(low + up, 16), " to log in"),
        lambda: ('"passcode": "', pick(dig, 6), '",'),  # short, digits only
        lambda: ("my pin: ", pick(dig, 4), " please"),
        lambda: ("wifi password: ", pick(low, 3) + "!" + pick(low, 3) + "#" + pick(dig, 2), " upstairs"),  # symbols cut it into short parts
        lambda: ("login = '", pick(low, 4) + "@" + pick(low, 2) + "$" + pick(low + dig, 4), "'"),
        lambda: ("Authorization: Bearer ", pick(low + up + dig, 32), ""),
        lambda: ("clone from https://bob:", pick(low + up + dig, 14), "@git.local now"),
        lambda: ("credential ", pick(low + up + dig, 24), " was leaked"),
        lambda: ("deploy with ghx_", pick(low + up + dig, 36), " and go"),
    ]
    out = []
    for i in range(n):
        a, v, b = forms[i % len(forms)]()
        a = "We met on Monday and talked about the plan. " + a
        whole = len(a) - 4 if v and a.endswith("ghx_") else len(a)
        out.append((a + v + b + " The rest of the day was quiet, as usual.", whole, len(a) + len(v)))
    return out


def test_unseen_forms(field):
    hit, wrong = 0, 0
    for t, s, e in made():
        got = [(a, b) for a, _, b in secrets.all_spans(t, field)[1]]
        hit += any(a <= s and e <= b and b - a <= e - s + 30 for a, b in got)
        wrong += sum(not (a < e and s < b) for a, b in got)
    assert hit >= 180 and wrong <= 6, (hit, wrong)


def test_base_finds_few_of_them():
    """Most of those forms are the field's to find."""
    assert sum(any(a <= s and e <= b for a, _, b in secrets.base_spans(t)) for t, s, e in made()) <= 30


def test_clean_text(spark, field):
    """False spans: none in sentences about secrets, and under one in 200 documents of the given table."""
    said = [
        "The password was changed yesterday and the token expired.", "Please keep the secret; the key of the door is under the mat.", "See chapter 4, pages 12-19: the authors note a basic result.",
        "Call +1 (743) 555-3824 or write to jane.doe@example.com before 2024-05-17 10:30.", "Version 2.10.3 was released under the Apache License, Version 2.0.", "L'auteur n'a pas dit son mot de passe.",
        "https://www.example.com/news/2021/some-long-title-of-a-page.html is a link", "width=200, height=100, lang=en", "The login page is https://example.com/login and works.", "He said: nothing.",
    ]
    assert [t for t in said if field.spans(t)] == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    added = sum(len(every) - len(base) for base, every in (secrets.all_spans(d.text or "", field) for d in docs))
    assert added <= len(docs) / 200


def test_islands_change_nothing(spark, field):
    """Looking only around tokens that are not plain gives the tags of Viterbi over the whole text."""
    assert field.safe()
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(250).collect()] + [t for t, *_ in made(100)]
    texts += [" ".join(a for a, *_ in made(30, s)) + " plain words, " * 40 for s in range(3)]
    r = random.Random(3)
    texts += ["".join(r.choice(["a", "Bc ", "=", ":", "9", " ", "!", "\n", "password", "key ", "x_y", '"', "é", "-", ".,"]) for _ in range(300)) for _ in range(40)]
    for t in texts:
        assert field.spans(t) == field.spans(t, whole=True)


def test_viterbi_is_best(field):
    """Against all taggings of short chains."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 4):
        e = rng.normal(size=(n, 3)) * 3
        score = lambda tags: sum(e[i, x] for i, x in enumerate(tags)) + sum(field.trans[a, b] for a, b in zip((0, *tags), (*tags, 0)))  # noqa: E731, B023
        every = [tuple(int(c) for c in np.base_repr(k, 3).zfill(n)) for k in range(3**n)]
        assert score(secrets._viterbi(e, field.trans)) == pytest.approx(max(map(score, every)))


def test_gradient():
    """A fitted field prefers the labelled tags of its own lines."""
    lines = [(f"pwd = {v} and more words", [(6, 6 + len(v))], ("eq1", "line0")) for v in ("abcdef", "xyzuvw", "qrstuv")] + [("plain words and more words", [], ("eq0", "line0"))] * 3
    f = secrets.fit(lines)
    assert f.spans("pwd = mnopqr and more words") == [(6, 12)] and f.spans("more plain words and words") == []
    assert secrets.fit([("plain words", [], ("eq0", "line0"))]).spans("pwd = mnopqr") == []


def test_examples_hold_their_values():
    """Values lie where their spans say, and lines with and without are both there."""
    got = secrets.examples(500)
    assert all(0 <= a < b <= len(t) and not re.search(r"\s|\0", t[a:b]) for t, v, _ in got for a, b in v)
    assert 150 < sum(bool(v) for _, v, _ in got) < 400 and got == secrets.examples(500)
