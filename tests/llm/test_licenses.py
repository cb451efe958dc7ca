import numpy as np

from tidewater.llm import licenses as L
from tidewater.llm.common import WordHash


def brute(text, templates):
    """Templates of which some run of the text, as long as a window, holds enough shingles."""
    table, out = WordHash(), set()
    h = L.shingles(text or "", table)
    for name, t in templates.items():
        s = set(np.unique(L.shingles(t, table)).tolist())
        half = 1 << (len(s) + len(s) // 4 - 1).bit_length()
        for i in range(0, max(1, len(h)), half):
            if s and len(s & set(h[i : i + 2 * half].tolist())) >= L.CONTAINMENT * len(s):
                out.add(name)
    return out


def test_equals_brute_force(spark):
    deal = np.random.default_rng(0)
    words = [f"w{k}" for k in range(50)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "released under the mit license"), (4, "w " * 100_000 + L.TEMPLATES["MIT-text"] + " w" * 100), (5, L.TEMPLATES["CC-BY-NC-4.0"] * 3)]
    for i in range(6, 200):
        text = deal.choice(words, int(deal.integers(1, 150))).tolist()
        for name in deal.choice(list(L.TEMPLATES), int(deal.integers(0, 3))):
            t = L.TEMPLATES[name].split()
            for _ in range(int(deal.integers(0, 3))):
                t[int(deal.integers(0, len(t)))] = "edited"
            at = int(deal.integers(0, len(text) + 1))
            text[at:at] = t
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (3, rows[3][1]), (None, rows[3][1])]], "doc_id long, text string, license string")
    got = L.scan(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.license)
        assert L.CONTAINMENT <= r.containment <= 1
    for i, t in rows:
        assert by.get(i, set()) == brute(t, L.TEMPLATES)
    assert by[None] == {"MIT"} and sum(r.doc_id == 3 for r in got) == 2
    place = next(r for r in got if r.doc_id == 4)
    assert place.first_word == 100_000


def test_none(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(df).collect() == []
    assert L.scan(spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string"), {}).collect() == []


def test_what_stands_before_does_not_matter():
    """The same matches for a text alone and after others of any length."""
    deal = np.random.default_rng(3)
    scanner = L.Scanner(L.TEMPLATES)
    for name in ("Apache-2.0-header", "GPL-header", "ISC-text", "BSD-conditions"):
        words = L.TEMPLATES[name].split()
        at = int(deal.integers(1, len(words)))
        text = " ".join([*["lead"] * int(deal.integers(0, 200)), *words[:at], *(f"more{k}" for k in range(10)), *words[at:]])
        alone = scanner.scan([text])
        for n in range(1, 140, 7):
            assert [(k, a, c) for d, k, a, c in scanner.scan(["x " * n, text]) if d == 1] == [(k, a, c) for _, k, a, c in alone]


def test_insertions_at_every_offset():
    """A notice with a fifth of words inserted at one place, which costs four shingles, is found wherever it stands."""
    scanner = L.Scanner(L.TEMPLATES)
    for name in ("ISC-text", "GPL-header"):
        words = L.TEMPLATES[name].split()
        edited = [*words[:9], *(f"more{k}" for k in range(len(words) // 5)), *words[9:]]
        assert all(name in {scanner.names[k] for _, k, *_ in scanner.scan([" ".join(["lead"] * n + edited)])} for n in range(130))
